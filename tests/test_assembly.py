"""Streams of lines far out of order: waiting lines stand in the state by blocks."""

from pyspark.sql import functions as F

from logveil.streaming import streams


def test_lines_far_ahead_wait_packed(spark, tmp_path):
    lines = spark.range(1, 6001).select(F.expr("'p' || id % 2").alias("path"), F.expr("(id + 1) div 2").alias("line_no"), F.expr("CASE (id + 1) div 2 % 3 WHEN 1 THEN '{\"a\":' WHEN 2 THEN id || '}' ELSE 'text' END").alias("line"))
    halves = [lines.where("line_no > 1"), lines.where("line_no = 1")]
    for n, half in enumerate(halves):
        half.write.mode("append").parquet(str(tmp_path / "in"))
        stream = streams.assemble_stream(spark.readStream.schema(lines.schema).parquet(str(tmp_path / "in")))
        writer = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(once=True)
        writer.start(str(tmp_path / "out")).awaitTermination()
        got = spark.read.schema(streams.CHUNK).parquet(str(tmp_path / "out")) if n else None
        if n == 0:
            state = spark.read.format("statestore").option("path", str(tmp_path / "state")).load()
            assert state.agg(F.sum(F.length(F.to_json("value"))).alias("n")).first()["n"] < 40_000
    want = streams.assemble(lines)
    assert got.count() == 4000 and got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
