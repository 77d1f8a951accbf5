"""Streams of lines: masking, scans, counts, growing dictionaries and assembly of JSON documents."""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from logveil.functions.jsonscan import Scanner
from logveil.operators.mask import mask_text
from logveil.operators.reports import scan_lines
from logveil.plans.options import Options
from logveil.sources.shared import spread


def read_lines(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    """(path, line) of text files that arrive in a folder."""
    return spark.readStream.options(**options).text(folder).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"))


def mask_stream(lines: DataFrame, options: Options, line: str = "line") -> DataFrame:
    """Masks each line for itself (append mode).  Pseudonyms have no collision suffix; see grow_dictionary."""
    return mask_text(lines, options, line)


def scan_stream(lines: DataFrame, options: Options, line: str = "line") -> DataFrame:
    """Scan events per line (append mode)."""
    return scan_lines(lines, options, line)


def count_stream(lines: DataFrame, options: Options, line: str = "line") -> DataFrame:
    """Running replacement counts by tag (update or complete mode)."""
    masked = mask_text(lines, options, line, replacements="found")
    return masked.select(F.explode("found").alias("r")).groupBy(F.col("r.tag").alias("tag")).count()


#: Rows of a growing dictionary.
ENTRY = "tag string, original string, normalized string, pseudonym string"
_FOUND = "base string, tag string, original string, normalized string"
#: The values that share a pseudonym but for its suffix, in the order of their suffixes.
_NAMES = "names array<string>"
#: Values that a task remembers, so as to pass each on about once.
_SEEN = 1 << 16
_STORE = "spark.sql.streaming.stateStore"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _once(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Drops rows that a task has passed on lately, so a value in most lines is a few rows a task behind it."""
    seen: set[tuple] = set()
    for rows in batches:
        rows = rows.drop_duplicates()
        fresh = [r not in seen for r in rows.itertuples(index=False, name=None)]
        rows = rows[fresh]
        if len(seen) + len(rows) > _SEEN:
            seen = set()
        seen |= set(rows.itertuples(index=False, name=None))
        yield rows


def _named(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Entries of a base's values that are new, with the suffixes after those in use."""
    base = key[0]
    names = list(state.get[0]) if state.exists else []
    new: dict[str, tuple[str, str]] = {}
    for rows in batches:
        for tag, original, normalized in zip(rows["tag"], rows["original"], rows["normalized"], strict=True):
            if normalized not in names:
                new[normalized] = min(new.get(normalized, (original, tag)), (original, tag))
    out = []
    for normalized in sorted(new):
        names.append(normalized)
        original, tag = new[normalized]
        out.append((tag, original, normalized, base if len(names) == 1 else f"{base[:-1]}_{len(names)}]"))
    if out:
        state.update((names,))
    yield pd.DataFrame(out, columns=["tag", "original", "normalized", "pseudonym"])


def new_entries(lines: DataFrame, options: Options, line: str = "line") -> DataFrame:
    """Stream: a dictionary's new rows (append mode).  Known values give none and keep their suffixes.

    The state holds the values by pseudonym, so a batch reads and writes the values that it has and
    nothing else, however large the dictionary is.  New values of one batch are numbered in their order;
    of several spellings of a new value the smallest of its batch stays.
    """
    # a batch may be one file; its lines are masked by all tasks
    found = mask_text(spread(lines.select(line)), options, line, replacements="found").select(F.explode("found").alias("r")).where("r.reversible")
    values = found.select(F.col("r.pseudonym").alias("base"), "r.tag", "r.original", "r.normalized").mapInPandas(_once, _FOUND)
    return values.groupBy("base").applyInPandasWithState(_named, ENTRY, _NAMES, "append", GroupStateTimeout.NoTimeout)


def grow_dictionary(lines: DataFrame, options: Options, table: str, checkpoint: str, line: str = "line", trigger: dict | None = None):
    """Starts a query that appends the new values of each batch to a dictionary table (Parquet, each batch once).

    The state is kept in RocksDB and its changes in the checkpoint folder.  `trigger` as in a stream's writer.
    """
    conf = lines.sparkSession.conf
    wanted = {f"{_STORE}.providerClass": _ROCKSDB, f"{_STORE}.rocksdb.changelogCheckpointing.enabled": "true"}
    before = {k: conf.get(k, None) for k in wanted}
    writer = new_entries(lines, options, line).writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    for k, v in wanted.items():
        conf.set(k, v)
    try:
        # a query keeps the settings with which it starts
        return (writer.trigger(**trigger) if trigger else writer).start(table)
    finally:
        for k, v in before.items():
            if v is None:
                conf.unset(k)
            else:
                conf.set(k, v)


CHUNK = "path string, chunk_no long, kind string, chunk string"
#: Packed lines that wait for one before them, with their blocks, and the scanner as JSON.
_STATE = "next_line long, next_chunk long, blocks array<long>, waiting array<string>, scanner string"
#: Lines of a file that wait together, and lines that a task holds while it packs them.
_BLOCK, _AT_HAND = 1024, 200_000


def _without_ends(pieces: list[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """Pieces of a line without the line feed behind a document."""
    before = ""
    for kind, chunk in pieces:
        if not (before == "json" and chunk == "\n"):
            yield kind, chunk
        before = kind


def assemble(lines: DataFrame) -> DataFrame:
    """Batch: (path, line_no, line) to (path, chunk_no, kind, chunk), JSON documents over any number of lines put together.

    The lines of a file are read in order by one task, each once; it holds one document at a time.  The line feed behind a document belongs to no chunk.
    """

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path, scanner, number = None, Scanner(), 0
        for rows in batches:
            out: list[tuple] = []

            def put(pieces: list[tuple[str, str]], out: list[tuple] = out) -> None:
                nonlocal number
                for kind, chunk in _without_ends(pieces):
                    out.append((path, number, kind, chunk))
                    number += 1

            for p, line in zip(rows["path"], rows["line"], strict=True):
                if p != path:
                    put(scanner.finish())
                    path, number = p, 0
                put(scanner.feed(f"{line}\n"))
            yield pd.DataFrame(out, columns=["path", "chunk_no", "kind", "chunk"])
        yield pd.DataFrame([(path, number + i, k, c) for i, (k, c) in enumerate(_without_ends(scanner.finish()))], columns=["path", "chunk_no", "kind", "chunk"])

    ordered = lines.repartition("path").sortWithinPartitions("path", "line_no")
    return ordered.select("path", "line").mapInPandas(walk, CHUNK)


def _pack(lines: list[tuple[int, str]]) -> str:
    return base64.b64encode(zlib.compress(json.dumps(lines).encode())).decode()


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Lines (path, block, line_no, line) to one row for those of a block that a task has at hand."""
    held: dict[tuple[str, int], list[tuple[int, str]]] = {}
    count = 0

    def handed_on() -> pd.DataFrame:
        rows = [(path, block, _pack(lines)) for (path, block), lines in held.items()]
        held.clear()
        return pd.DataFrame(rows, columns=["path", "block", "lines"])

    for rows in batches:
        for path, block, n, line in zip(rows["path"], rows["block"], rows["line_no"], rows["line"], strict=True):
            held.setdefault((path, int(block)), []).append((int(n), line))
        count += len(rows)
        if count >= _AT_HAND:
            yield handed_on()
            count = 0
    if held:
        yield handed_on()


def _unpacked(parts: list[str]) -> dict[int, str]:
    return {n: line for part in parts for n, line in json.loads(zlib.decompress(base64.b64decode(part)))}


def assemble_stream(lines: DataFrame, timeout_ms: int = 60_000) -> DataFrame:
    """Stream: the same per path.  Lines may arrive in any order: those ahead of a gap wait in the state.

    A line is scanned when its turn comes and never again.  A path that is silent for `timeout_ms` gives what is left.
    Waiting lines stand in the state packed by blocks of their numbers; a task unpacks one block at a time.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, number, blocks, packed, kept = state.get if state.exists else (1, 0, [], [], "null")
        waiting: dict[int, list[str]] = {}
        for block, part in zip(blocks, packed, strict=True):
            waiting.setdefault(int(block), []).append(part)
        scanner = Scanner.resumed(json.loads(kept))

        def chunks(out: list[tuple[str, str]]) -> pd.DataFrame:
            nonlocal number
            rows = [(key[0], number + i, k, c) for i, (k, c) in enumerate(out)]
            number += len(out)
            return pd.DataFrame(rows, columns=["path", "chunk_no", "kind", "chunk"])

        if state.hasTimedOut:
            for block in sorted(waiting):
                yield chunks([x for _, line in sorted(_unpacked(waiting[block]).items()) for x in _without_ends(scanner.feed(f"{line}\n"))])
            yield chunks(list(_without_ends(scanner.finish())))
            state.remove()
            return
        for rows in batches:
            for block, part in zip(rows["block"], rows["lines"], strict=True):
                waiting.setdefault(int(block), []).append(part)
        while True:
            block, out = at // _BLOCK, []
            ahead = _unpacked(waiting.pop(block, []))
            while at in ahead and at // _BLOCK == block:
                out += _without_ends(scanner.feed(f"{ahead.pop(at)}\n"))
                at += 1
            if ahead:
                waiting[block] = [_pack(list(ahead.items()))]
            yield chunks(out)
            if at // _BLOCK == block:
                break
        parts = [(block, part) for block, some in waiting.items() for part in some]
        state.update((at, number, [b for b, _ in parts], [p for _, p in parts], json.dumps(scanner.state())))
        state.setTimeoutDuration(timeout_ms)

    blocks = lines.select("path", F.floor(F.col("line_no") / _BLOCK).alias("block"), "line_no", "line").repartition("path", "block")
    packed = blocks.mapInPandas(_packed, "path string, block long, lines string")
    return packed.groupBy("path").applyInPandasWithState(step, CHUNK, _STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)
