"""Costly work is dealt over all tasks, whatever the files and row groups of the input."""

from pyspark.sql import functions as F

from logveil import queries, rule_queries
from logveil.operators import jobs
from logveil.operators.jobs import units


def test_lines_of_one_row_group_are_dealt_over_all_tasks(spark, tmp_path):
    events = spark.range(2000).select(F.col("id").alias("event_id"), (F.col("id") % 10).alias("user_id"), F.lit("x").alias("event_type"))
    events.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    for lines in (queries.log_lines(spark, str(tmp_path), "kv", "mail"), rule_queries.rule_lines(spark, str(tmp_path), "jwt", "iban")):
        sizes = lines.groupBy(F.spark_partition_id().alias("p")).count().collect()
        assert sum(r["count"] for r in sizes) == 4000 and len(sizes) >= 4 and max(r["count"] for r in sizes) < 1000


def test_units_of_a_long_file_come_in_pieces(spark):
    text = "".join(f'line {i}\n{{"a":\n {i}}} b\n' for i in range(30_000))
    rows = spark.createDataFrame([("a", text), ("b", None), ("c", "one")], "path string, text string").coalesce(1)
    found = units(rows)
    assert "MapInPandas" in found._jdf.queryExecution().executedPlan().toString()
    got = {(r["path"], r["n"], r["last"], r["lines"]) for r in found.groupBy("path").agg(F.count("line").alias("n"), F.max("line_no").alias("last"), F.sum("n_lines").alias("lines")).collect()}
    assert got == {("a", 60_000, 89_999, 90_000), ("c", 1, 1, 1)}


def test_units_of_one_file_are_masked_by_all_tasks(spark, tmp_path):
    (tmp_path / "a.log").write_text("".join(f"contact u{i}@bank.com\n" for i in range(2000)))
    job = jobs.mask_folder(spark, str(tmp_path), None, queries.OPTIONS)
    assert job.rows.count() == 2000 and len({r["f"] for r in job.rows.select(F.input_file_name().alias("f")).distinct().collect()}) >= 4
