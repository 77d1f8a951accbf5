"""Lines are masked once, whatever reads them afterwards."""

import pytest
from pyspark.sql import functions as F

from logveil import rule_queries
from logveil.operators import mapping


def test_roundtrip_reads_written_lines(spark, tmp_path):
    events = spark.range(50).select(F.col("id").alias("event_id"), (F.col("id") % 10).alias("user_id"), F.lit("x").alias("event_type"))
    events.write.parquet(str(tmp_path / "events.parquet"))
    back = rule_queries.rule_roundtrip(spark, str(tmp_path))
    assert back.inputFiles() and not any("events.parquet" in f for f in back.inputFiles())
    lines = rule_queries.rule_lines(spark, str(tmp_path), *rule_queries._RESTORED).select("event_id", "kind", "line")
    assert back.count() == 300 and back.exceptAll(lines).count() == 0


@pytest.mark.parametrize("kind", ["long", "string"])
def test_rows_with_null_and_shared_ids_come_back(spark, kind):
    rows = [(None, "[USER_a] x"), (None, "[USER_b] [USER_a]"), (1, "[USER_b]"), (1, "[USER_c]"), (1, "[USER_b]"), (2, None), (None, None), (3, "plain")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("doc_id", F.col("doc_id").cast(kind))
    known = spark.createDataFrame([("[USER_a]", "ann"), ("[USER_b]", "bob")], "pseudonym string, original string")
    got = mapping.reidentify(docs, known)
    want = [(None, "ann x"), (None, "bob ann"), (1, "bob"), (1, "[USER_c]"), (1, "bob"), (2, None), (None, None), (3, "plain")]
    assert sorted(map(str, ((r["doc_id"] and int(r["doc_id"]), r["text"]) for r in got.collect()))) == sorted(map(str, want))
