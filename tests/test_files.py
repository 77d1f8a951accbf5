import gzip
import json

from pyspark.sql import functions as F

from logveil.functions.hashing import Key
from logveil.functions.sqlfuncs import register
from logveil.operators import mask
from logveil.plans.options import Options
from logveil.sources import files, sinks
from logveil.streaming import streams


def test_charsets_and_gzip(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.log").write_bytes(b"one\r\ntwo\n")
    (tmp_path / "sub" / "b.log").write_bytes("Привет, мир".encode("cp1251"))
    (tmp_path / "c.log").write_bytes(gzip.compress(b"packed"))
    (tmp_path / "d.log").write_bytes(b"")
    got = {r["path"].rsplit("/", 1)[1]: (r["charset"], r["gzipped"], r["text"]) for r in files.whole_files(spark, str(tmp_path), "*.log").collect()}
    assert got == {"a.log": ("utf-8", False, "one\ntwo\n"), "b.log": ("cp1251", False, "Привет, мир"), "c.log": ("utf-8", True, "packed")}


def test_mapping_document(spark, tmp_path):
    rows = spark.createDataFrame([("a", "[USER_1]"), ("b", "[USER_2]")], "original string, pseudonym string")
    sinks.export_mapping(rows, str(tmp_path / "m"))
    assert sorted(map(tuple, files.load_mapping(spark, str(tmp_path / "m")).collect())) == [("a", "[USER_1]"), ("b", "[USER_2]")]
    sinks.write_mapping(rows, str(tmp_path / "p"))
    assert sinks.read_back(rows, str(tmp_path / "p")).count() == 0


def test_reports(spark, tmp_path):
    rows = spark.sql("select 'f' as path, map('IP', 2) as stats, array('a', 'b') as issues")
    for form in ("jsonl", "json", "csv"):
        sinks.write_report(rows, str(tmp_path / form), form)
    text = "".join(p.read_text() for p in (tmp_path / "json").glob("part-*"))
    assert json.loads(text) == [{"path": "f", "stats": {"IP": 2}, "issues": ["a", "b"]}]
    assert "a; b" in "".join(p.read_text() for p in (tmp_path / "csv").glob("part-*"))


def test_sql_functions(spark):
    options = Options(key=Key.derive("s", 5))
    register(spark, options)
    want = spark.range(1).select(mask.masked_value(F.lit("Joe@Bank.com"), "EMAIL", options)["out"]).first()[0]
    assert spark.sql("select logveil_mask_email('to Joe@Bank.com!'), logveil_mask_format('Ab-1')").first()[:] == (f"to {want}!", "Xx-9")


def test_assembly(spark):
    lines = ["x", '{"a":', "1}", "y", "{broken"]
    rows = spark.createDataFrame([("f", i + 1, t) for i, t in enumerate(lines)], "path string, line_no long, line string")
    got = [(r["kind"], r["chunk"].strip()) for r in streams.assemble(rows).orderBy("chunk_no").collect() if r["chunk"].strip()]
    assert got == [("text", "x"), ("json", '{"a":\n1}'), ("text", "y"), ("text", "{broken")]


def test_stream_assembly_puts_lines_in_order(spark, tmp_path):
    rows = spark.createDataFrame([("f", 3, "1}"), ("f", 1, "x"), ("f", 2, '{"a":'), ("g", 1, "[2]")], "path string, line_no long, line string")
    rows.write.json(str(tmp_path / "in"))
    stream = streams.assemble_stream(spark.readStream.schema(rows.schema).json(str(tmp_path / "in")))
    running = stream.writeStream.format("memory").queryName("assembled").outputMode("append").trigger(once=True).start()
    running.awaitTermination()
    assert sorted((r["path"], r["kind"]) for r in spark.table("assembled").collect() if r["chunk"].strip()) == [("f", "json"), ("f", "text"), ("g", "json")]


def test_parts_of_many_tasks_are_in_order_by_name(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "PART_TASKS", 3, raising=False)
    rows = spark.range(600).select(F.lit("a.log").alias("path"), F.col("id").alias("line_no"), F.concat(F.lit("line "), "id").alias("line"))
    sinks.write_text_mirror(rows, str(tmp_path / "out"), part_lines=10)
    parts = sorted((tmp_path / "out" / "rel_path=a.log").glob("part-*"))
    assert "".join(p.read_text() for p in parts).splitlines() == [f"line {i}" for i in range(600)]
    assert len(parts) >= 60 and max(int(p.name.split("-")[1]) for p in parts) < 3 and max(len(p.read_text().splitlines()) for p in parts) <= 10
