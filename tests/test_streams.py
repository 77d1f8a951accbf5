"""Registered streams end in files and not in the driver."""

import json
import random
import re
import time

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from logveil import queries
from logveil.functions.hashing import Key
from logveil.functions.jsonscan import Scanner, pieces
from logveil.operators import mapping, mask
from logveil.plans.options import Options
from logveil.streaming import streams


def test_stream_mask_is_drained_to_files(spark, tmp_path):
    pq.write_table(pa.table({"event_id": range(50), "user_id": [i % 7 for i in range(50)], "event_type": ["login"] * 50}), f"{tmp_path}/events.parquet")
    got = queries.stream_mask(spark, str(tmp_path))
    assert got.inputFiles() and not spark.catalog.tableExists("logveil_stream_mask")
    rows = {r["event_id"]: r["line"] for r in got.collect()}
    assert len(rows) == 50 and len(set(rows.values())) == 7 and not any("u3" in x for x in rows.values())
    assert queries.stream_mask(spark, str(tmp_path)).count() == 50


def test_dictionary_grows_over_batches_and_restarts(spark, tmp_path):
    options = Options(key=Key(b"k", hash_len=1))
    table, state, arrived = f"{tmp_path}/table", f"{tmp_path}/state", f"{tmp_path}/lines"
    seen: dict[tuple, str] = {}
    for number, users in enumerate((range(0, 30), range(20, 60), range(5, 70))):
        lines = [f"mail u{n}@bank.com and U{n}@bank.com, root@bank.com" for n in users] + [None, "", "nothing"]
        spark.createDataFrame([(x,) for x in lines], "line string").coalesce(1).write.mode("append").parquet(arrived)
        stream = spark.readStream.schema("line string").parquet(arrived)
        provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
        streams.grow_dictionary(stream, options, table, state, trigger={"availableNow": True}).awaitTermination()
        assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == provider
        rows = spark.read.schema(streams.ENTRY).parquet(table).collect()
        now = {(r["tag"], r["normalized"]): r["pseudonym"] for r in rows}
        # every value once, every name once, and names once given stay
        assert len(rows) == len(now) == len(set(now.values()))
        assert all(now[k] == v for k, v in seen.items())
        used: dict[str, list[int]] = {}
        for name in now.values():
            base, suffix = re.fullmatch(r"(\[EMAIL_[0-9a-f])(?:_(\d+))?\]", name).groups()
            used.setdefault(base, []).append(int(suffix or 1))
        assert all(sorted(u) == list(range(1, len(u) + 1)) for u in used.values())
        seen = now
    assert set(seen) == {("EMAIL", f"u{n}@bank.com") for n in range(70)} | {("EMAIL", "root@bank.com")}
    assert {r["original"] for r in rows if r["normalized"] == "u5@bank.com"} == {"U5@bank.com"}


def test_one_batch_names_values_as_a_dictionary_of_all_does(spark, tmp_path):
    options = Options(key=Key(b"k", hash_len=1))
    spark.range(300).select(F.concat(F.lit("mail u"), F.col("id") % 40, F.lit("@bank.com")).alias("line")).write.parquet(f"{tmp_path}/lines")
    stream = spark.readStream.schema("line string").parquet(f"{tmp_path}/lines")
    streams.grow_dictionary(stream, options, f"{tmp_path}/table", f"{tmp_path}/state", trigger={"availableNow": True}).awaitTermination()
    masked = mask.mask_text(spark.read.parquet(f"{tmp_path}/lines"), options, "line", replacements="found")
    want = mapping.build(mapping.replacements(masked, "found"))
    got = spark.read.schema(streams.ENTRY).parquet(f"{tmp_path}/table")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))


def test_lines_that_begin_no_document():
    found = fed('[2026-01-01] INFO\n{"a":\n1}\n[bad\n{"b": [1,\n')
    assert found == [("text", "[2026-01-01] INFO\n"), ("json", '{"a":\n1}'), ("text", "\n"), ("text", "[bad\n"), ("text", '{"b": [1,\n')]
    assert fed('{"a": "no end\n{"b": 2}\n') == [("text", '{"a": "no end\n'), ("json", '{"b": 2}'), ("text", "\n")]


def fed(text: str, resume: bool = False) -> list[tuple[str, str]]:
    scanner, out = Scanner(), []
    for line in re.findall(r"[^\n]*\n|[^\n]+", text):
        out += scanner.feed(line)
        if resume:
            scanner = Scanner.resumed(json.loads(json.dumps(scanner.state())))
    return out + scanner.finish()


def test_scanner_against_a_parser():
    rng = random.Random(1)
    for _ in range(4000):
        text = "".join(rng.choice(["{", "}", "[", "]", '"a"', ":", ",", "1", "\n", "\n", " ", "x", '{"k":1}', '"\\n"', "true", "\0", '"\\ud800"', "-0.5e3"]) for _ in range(rng.randint(1, 30)))
        found = fed(text)
        assert "".join(c for _, c in found) == text and fed(text, resume=True) == found
        assert "".join(c for _, c in pieces(text)) == text
        assert [c for k, c in pieces(text) if k == "json"] == [c for k, c in found if k == "json"]
        assert all(isinstance(json.loads(c), dict | list) for k, c in found if k == "json")
        try:
            whole = isinstance(json.loads(text), dict | list)
        except ValueError:
            whole = False
        assert whole == ([k for k, c in found if c.strip()] == ["json"])


def test_scanner_time_is_linear():
    def seconds(n: int, line: str, last: str) -> float:
        start = time.process_time()
        fed("{\n" + line * n + last)
        return time.process_time() - start

    for line, last in (('"k": [1, 2,\n{"a": null}],\n', '"z": 0}\n'), ('"k": {\n', "oops\n"), ('"a":\n[1,\n{"q": 1},\n{"b": \n1},\n', "oops\n")):
        seconds(100, line, last)
        assert seconds(16_000, line, last) < 12 * max(seconds(4_000, line, last), 0.01)
