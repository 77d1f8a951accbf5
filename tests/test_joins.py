"""Joins under frequent keys, places of values, and re-identification of a value that stands in most lines."""

import random
import re

import pytest
from pyspark.sql import functions as F

from logveil.operators import diff, joins, mapping


def test_lookup_with_frequent_and_null_keys(spark):
    rows = [(n, "hot" if n % 2 else f"k{n % 30}") for n in range(4000)] + [(-1, None), (-2, "unknown")]
    table = spark.createDataFrame([("hot", "H")] + [(f"k{n}", f"v{n}") for n in range(0, 20)], "key string, value string")
    df = spark.createDataFrame(rows, "n long, key string")
    assert [r["key"] for r in joins.frequent(df, "key", 10).collect()] == ["hot"]
    assert joins.frequent(df.limit(0), "key").count() == 0
    want = {r["key"]: r["value"] for r in table.collect()}
    for share in (10, 1000):
        got = joins.lookup(df, table, "key", "value", share).collect()
        assert sorted((r["n"], r["value"] or "") for r in got) == sorted((n, want.get(k) or "") for n, k in rows)


def test_rows_of_frequent_keys_are_spread(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(20_000).select("id", F.when(F.col("id") % 10 == 0, F.col("id").cast("string")).otherwise("hot").alias("key"))
        table = df.select("key").distinct().withColumn("value", F.upper("key"))
        got = joins.lookup(df, table, "key", "value")
        sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 20_000 and max(sizes) < 2 * min(sizes)
        assert got.where("value <=> upper(key)").count() == 20_000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plain_spans(text: str, values: dict[str, str]) -> list[tuple]:
    """By one regular expression of all values, the longest first."""
    body = "|".join(re.escape(v) for v in sorted(values, key=lambda v: (-len(v), v)))
    return [(m.start(), m.end(), m.group(), values[m.group()]) for m in re.finditer(rf"(?<!\w)(?:{body})(?!\w)", text)]


def test_value_spans_against_one_regular_expression(spark):
    rng = random.Random(5)
    parts = ["a", "bc", "10", "0", ".", "-", "@", " ", " ", "/", "::", "[", "]", "\n", "é", "d_1", "￿"]
    word = lambda n: "".join(rng.choice(parts) for _ in range(rng.randint(1, n)))
    values = {v: rng.choice(["IP", "USER"]) for v in (word(9) for _ in range(300)) if re.search(r"\w", v)}
    texts = [word(60) for _ in range(400)] + ["", "é" * 50, "10.10", " ".join(["bc"] * 3000)]
    docs = spark.createDataFrame([(n if n % 7 else None, t) for n, t in enumerate(texts)] + [(1, texts[1]), (2, None)], "doc_id long, text string")
    known = spark.createDataFrame([(v, t) for v, t in values.items()] + [(None, "X"), ("", "X"), ("::", "X")], "value string, tag string")
    got = sorted(((-1 if r["doc_id"] is None else r["doc_id"], r["start"], r["end"], r["value"], r["tag"]) for r in diff.value_spans(docs, known).collect()))
    # null ids: texts that are the same text give their spans once
    rows = {(n if n % 7 else -1, t) for n, t in enumerate(texts)} | {(1, texts[1])}
    assert got == sorted((n, *s) for n, t in rows for s in plain_spans(t, values)) and len(got) > 300


def test_value_spans_at_word_ends(spark):
    docs = spark.createDataFrame([(1, "from 10.0.0.1. admin administrator admin-x"), (2, "10.0.0.10 [::1]:80 x[::1]")], "doc_id long, text string")
    known = spark.createDataFrame([("10.0.0.1", "IP"), ("admin", "USER"), ("[::1]", "IP"), ("admin", "ACCOUNT")], "value string, tag string")
    got = sorted((r["doc_id"], r["start"], r["end"], r["tag"]) for r in diff.value_spans(docs, known).collect())
    assert got == [(1, 5, 13, "IP"), (1, 15, 20, "ACCOUNT"), (1, 35, 40, "ACCOUNT"), (2, 10, 15, "IP")]


def test_empty_tables_have_no_spans(spark):
    docs, known = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([("a", "T")], "value string, tag string")
    assert diff.value_spans(docs, known).count() == 0
    assert diff.value_spans(known.select(F.lit(1).alias("doc_id"), F.col("value").alias("text")), known.limit(0)).count() == 0


@pytest.mark.parametrize("ids", ["n", "null"])
def test_a_value_in_most_lines_comes_back(spark, ids):
    lines = spark.range(3000).select(F.expr(f"CAST({ids if ids == 'null' else 'id'} AS LONG)").alias("doc_id"), F.expr("concat('by [USER_00aa] at [IP_', lower(hex(id)), '] of [USER_ff]')").alias("text"), F.col("id").alias("n"))
    known = spark.range(3000).where("id % 2 = 0").select(F.expr("concat('[IP_', lower(hex(id)), ']')").alias("pseudonym"), F.expr("concat('ip', id)").alias("original"))
    known = known.unionByName(spark.createDataFrame([("[USER_00aa]", "root")], "pseudonym string, original string"))
    got = {r["n"]: r["text"] for r in mapping.reidentify(lines, known).collect()}
    assert got == {n: f"by root at {f'ip{n}' if n % 2 == 0 else f'[IP_{n:x}]'} of [USER_ff]" for n in range(3000)}
