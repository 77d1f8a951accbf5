"""Folder jobs on files of all shapes: nothing left in the clear, names by place, and texts restored."""

import json
import random
from dataclasses import replace

from pyspark.sql import functions as F

from logveil.functions.hashing import Key
from logveil.operators import jobs, jsondocs, mapping
from logveil.plans.options import Options
from logveil.sources import files, sinks

OPTIONS = Options(key=Key.derive("jobs", 5))


def run(spark, folder, options=OPTIONS):
    job = jobs.mask_folder(spark, str(folder), None, options)
    rows = {}
    for r in job.masked.orderBy("path", "line_no").collect():
        rows.setdefault(r["path"], []).append((r["line_no"], r["line"]))
    return job, rows


def test_shapes_leak_nothing(spark, tmp_path):
    (tmp_path / "a.ndjson").write_text('{"user":"erin","n":1.50}\n{"user":"frank"}\n')
    (tmp_path / "b.json").write_text('{\n  "user": "carol",\n  "deep": [{"password": "hunter22"}]\n}\n')
    (tmp_path / "c.log").write_text('start [1, 2]\n[3,4] kept as it is\n{"user": "grace",\n "x": "mail dave@bank.com"} tail\n{"user": "open\nend from 10.1.2.3\n')
    job, rows = run(spark, tmp_path)
    every = json.dumps(rows)
    assert not any(x in every for x in ("erin", "frank", "carol", "hunter22", "grace", "dave", "10.1.2.3"))
    assert [n for n, _ in rows["c.log"]] == [1, 2, 3, 5, 6] and rows["c.log"][1][1] == "[3,4] kept as it is" and rows["c.log"][2][1].endswith("} tail")
    assert json.loads(rows["b.json"][0][1])["deep"][0]["password"] != "hunter22" and rows["a.ndjson"][0][1].endswith('"n": 1.50}')
    assert {"erin", "frank", "carol", "grace", "dave@bank.com", "10.1.2.3"} <= {r["original"] for r in job.dictionary.collect()}
    report = {r["path"]: r.asDict() for r in job.report().collect()}
    assert report["c.log"]["line_count"] == 6 and report["c.log"]["changed_lines"] == 3 and report["b.json"]["line_count"] == 4 and report["a.ndjson"]["replacements"] == 2
    assert report["a.ndjson"]["size_bytes"] == len('{"user":"erin","n":1.50}\n{"user":"frank"}\n')


def test_colliding_values_of_one_line_come_back(spark, tmp_path):
    values = [f"u{i}@bank.com" for i in range(20)]
    (tmp_path / "a.log").write_text(" ".join([*values, *values[::-1]]) + "\n" + json.dumps({"mail": values, "user": "u3"}) + "\n")
    job, rows = run(spark, tmp_path, replace(OPTIONS, key=replace(OPTIONS.key, hash_len=1)))
    names = rows["a.log"][0][1].split(" ")
    assert len(set(names)) == 20 and names[:20] == names[:19:-1]
    back = mapping.reidentify(job.masked.withColumn("id", F.col("line_no")), job.dictionary, "line", "id")
    assert {r["line_no"]: r["line"] for r in back.collect()} == {1: " ".join([*values, *values[::-1]]), 2: json.dumps({"mail": values, "user": "u3"})}


def test_names_do_not_depend_on_whole_hashes(spark, tmp_path):
    lines = ["user=bob from 10.0.0.1 md5 0123456789abcdef0123456789abcdef", f"seen [EMAIL_{'a' * 12}] and [SHA_{'b' * 64}]", "10.0.0.1 10.0.0.2 10.0.0.3 x 0123456789abcdef0123456789abcdee sha1", ""]
    (tmp_path / "a.log").write_text("\n".join(lines))
    _, rows = run(spark, tmp_path)
    plain = jsondocs.mask_any(spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, text string"), OPTIONS)
    assert [x for _, x in rows["a.log"]] == [r["text"] for r in plain.orderBy("i").collect()][: len(rows["a.log"])]


def test_text_of_any_shape(spark):
    texts = ['{"user":"eve"}\r\n{"user":"eve2"}\r\n', '  {"a": "\\ud800 x"}  ', '{"user": ' * 3000, "", None, "[]", '{"a":1,"a":"b"}', '["10.0.0.1"]\nx\n', '{"user":""}', "{" * 5 + "\n", '{"k\\"":"10.0.0.1"}']
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = [r for r in jsondocs.mask_any(rows, OPTIONS, replacements="found").orderBy("i").collect()]
    out = [r["text"] for r in got]
    assert "eve" not in out[0] and out[0].count("\r\n") == 2 and out[0].endswith("}\r\n")
    assert out[1].startswith("  {") and out[1].endswith("}  ") and out[2] == texts[2] and out[3] == "" and out[4] is None and out[5] == "[]"
    assert out[6] == '{"a": "b"}' and "10.0.0.1" not in out[7] and out[7].startswith('["[IP_') and out[8] == '{"user": ""}' and out[9] == texts[9]
    assert json.loads(out[10])['k"'].startswith("[IP_") and [len(r["found"]) for r in got] == [2, 0, 0, 0, 0, 0, 0, 1, 0, 0, 1]


def random_logs(n, seed, most):
    rng = random.Random(seed)
    pick = [
        lambda: f"user=w{rng.randint(0, 99)}x src=10.{rng.randint(0, 255)}.{rng.randint(0, 255)}.9",
        lambda: f"Accepted password for op{rng.randint(0, 99)} from 192.168.{rng.randint(0, 255)}.4 port 22",
        lambda: f"mail to m{rng.randint(0, 99)}@bank.com ok",
        lambda: json.dumps({"user": f"j{rng.randint(0, 99)}q", "n": rng.randint(0, 99) / 4, "in": {"password": f"pw{rng.randint(0, 999)}zz"}}),
        lambda: f"nic 00:1a:2b:3c:4d:{rng.randint(16, 255):02x} up",
        lambda: f"open /home/h{rng.randint(0, 99)}z/x.log",
        lambda: "plain line of words",
    ]
    return ["\n".join(rng.choice(pick)() for _ in range(rng.randint(1, most))) for _ in range(n)]


def test_random_logs_are_safe_and_come_back(spark, tmp_path):
    safe, back = random_logs(200, 20, 5), random_logs(50, 21, 3)
    for i, text in enumerate(safe + back):
        (tmp_path / f"f{i:03}.log").write_text(text)
    job, rows = run(spark, tmp_path)
    assert len(rows) == 250 and job.report().where("not safe").select("path", "issues").collect() == []
    restored = mapping.reidentify(job.masked.withColumn("id", F.concat_ws(":", "path", "line_no")), job.dictionary, "line", "id")
    by_file = {}
    for r in restored.orderBy("path", "line_no").collect():
        by_file.setdefault(r["path"], []).append(r["line"])
    for i, text in enumerate(safe + back):
        assert "\n".join(by_file[f"f{i:03}.log"]) == text


def test_split_lines_and_parts(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    lines = [f"line {i} " + "x" * (i % 50) for i in range(6000)]
    (folder / "a +b.log").write_text("\n".join(lines) + "\n")
    (folder / "c.log").write_text("one\r\ntwo")
    (folder / "d.log").write_text("")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        found = files.numbered_text_lines(spark, str(folder))
        assert found.rdd.getNumPartitions() > 4
        got = sorted((r["path"].rsplit("/", 1)[1], r["line_no"], r["line"]) for r in found.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == sorted([("a +b.log", i + 1, x) for i, x in enumerate(lines)] + [("c.log", 1, "one"), ("c.log", 2, "two")])
    rows = spark.createDataFrame(got, "path string, line_no long, line string")
    sinks.write_text_mirror(rows, str(tmp_path / "out"), part_lines=1000)
    parts = sorted((tmp_path / "out" / "rel_path=a +b.log").glob("part-*")) or sorted(p for p in (tmp_path / "out").glob("rel_path=a*/part-*"))
    assert len(parts) >= 6 and "".join(p.read_text() for p in parts).splitlines() == lines
    assert sum(1 for _ in (tmp_path / "out").glob("rel_path=c.log/part-*")) == 1
