"""Checks of texts with very many values take time in proportion to them."""

import time

from pyspark.sql import functions as F

from logveil.functions.hashing import Key
from logveil.operators import detect
from logveil.plans.options import Options

OPTIONS = Options(key=Key.derive("salt", 10))


def test_many_different_leftovers_of_one_text(spark, tmp_path):
    rows = spark.range(1).select(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(100_000)), lambda i: F.concat(F.lit("contact u"), i.cast("string"), F.lit("@bank.com"))), "\n").alias("text"))
    rows.write.parquet(str(tmp_path / "text"))
    texts = spark.read.parquet(str(tmp_path / "text"))
    start = time.time()
    left = texts.select(F.size(detect.residual(F.col("text"), OPTIONS)).alias("n")).first()["n"]
    assert left == 100_000
    assert time.time() - start < 60
    assert detect.verify(texts, OPTIONS).first()["issues"] == ["EMAIL", "FQDN", "RESIDUAL: EMAIL"]


def test_leftovers_come_once_in_order(spark):
    rows = spark.createDataFrame([("b@x.com 10.0.0.2 a@x.com b@x.com 10.0.0.2",)], "text string")
    got = rows.select(detect.residual(F.col("text"), OPTIONS).alias("r")).first()["r"]
    assert [tuple(x) for x in got] == [("EMAIL", "b@x.com"), ("EMAIL", "a@x.com"), ("IP", "10.0.0.2")]
