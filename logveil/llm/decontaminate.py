"""Benchmark decontamination with a broadcast hash set of normalised test n-grams.

Words are runs of a-z, 0-9 and characters beyond ASCII after A-Z is lower-cased.
Every window of `size` words of a benchmark item goes into the set (an item of
fewer words is one window).  Tasks hash the windows of their documents, look them
up and compare the words of every hit, so a hash collision removes nothing.

The set is broadcast in blocks of at most `block_bytes`; one block is the usual
case, and more make one pass over the documents each, so that no broadcast grows
with the benchmark.  Documents are not shuffled and not grouped.

Defined results: a null or wordless text has no words and no hits; a wordless
item gives no window; a null item_id counts as the empty string; equal windows of
several items report each item; rows are judged one by one, so repeated rows get
equal results; an empty documents or benchmark table gives no hits.  Columns of
the documents are carried, and give way where they clash with the new ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logveil.llm.arrowcols import SPANS, appended, per_doc, runs
from logveil.llm.exchange import cut, small_batches
from logveil.llm.textbytes import ALNUM, Words, column_bytes, covered, slices, split_words, windows

WINDOW = 10
#: Most bytes of windows in one broadcast.
BLOCK_BYTES = 64 << 20
#: Columns that scan() adds.
FOUND = f"n_words long, n_hit long, spans {SPANS}, item_ids array<string>"


def _phrase(words: Words, at: int, size: int) -> bytes:
    return b" ".join(words.data[words.starts[i] : words.ends[i]].tobytes() for i in range(at, at + size))


def item_windows(benchmark: DataFrame, size: int = WINDOW, text: str = "text") -> DataFrame:
    """Windows of all items: (length in words, hash, phrase, item_id)."""

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, ids = split_words(batch.column("text"), ALNUM, lower=True), batch.column("item_id").to_pylist()
            rows: list[tuple] = []
            for doc, n in enumerate(words.counts):
                length = min(size, int(n))
                for at in range(words.first[doc], words.first[doc] + n - length + 1) if n else ():
                    rows.append((length, _phrase(words, at, length), ids[doc]))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.string())], names=["length", "phrase", "item_id"])

    source = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col(text).alias("text"))
    return source.mapInArrow(cut_up, "length int, phrase binary, item_id string").distinct()


class WindowSet:
    """Windows of one block, by length: their hashes, and their phrases with the items that hold them."""

    def __init__(self, rows: list[tuple[int, bytes, str]]):
        self.items: dict[bytes, list[str]] = {}
        by_length: dict[int, set[bytes]] = {}
        for length, phrase, item in rows:
            self.items.setdefault(phrase, []).append(item)
            by_length.setdefault(length, set()).add(phrase)
        self.hashes = {length: self._hashed(sorted(phrases), length) for length, phrases in by_length.items()}

    @staticmethod
    def _hashed(phrases: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
        words = split_words(pa.array([p.decode("utf-8", "surrogateescape") for p in phrases], pa.large_string()), ALNUM)
        hashes = np.unique(windows(words, length)[0])
        sieve = np.zeros(1 << 20, dtype=bool)
        sieve[hashes & np.uint64(0xFFFFF)] = True
        return hashes, sieve

    def hits(self, words: Words) -> tuple[np.ndarray, list[set[str]]]:
        """Flags of hit words, and the items of each document."""
        flags, items = np.zeros(len(words.hashes), dtype=bool), [set() for _ in words.counts]
        for length, (known, sieve) in self.hashes.items():
            hashes, at = windows(words, length)
            maybe = np.flatnonzero(sieve[hashes & np.uint64(0xFFFFF)])
            maybe = maybe[np.isin(hashes[maybe], known)]
            sure = []
            for place in at[maybe].tolist():
                if found := self.items.get(_phrase(words, place, length)):
                    sure.append(place)
                    items[int(np.searchsorted(words.first, place, side="right")) - 1].update(found)
            if sure:
                flags |= covered(np.array(sure), length, len(flags))
        return flags, items


def _scan_block(docs: DataFrame, rows: list[tuple], text: str, merge: bool) -> DataFrame:
    known = docs.sparkSession.sparkContext.broadcast(rows)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = WindowSet(known.value)
        for whole in batches:
            for batch in slices(whole):
                words = split_words(batch.column(text), ALNUM, lower=True)
                flags, items = block.hits(words)
                if merge:
                    for doc, (spans, more) in enumerate(zip(batch.column("spans").to_pylist(), batch.column("item_ids").to_pylist(), strict=True)):
                        items[doc].update(more)
                        for span in spans:
                            flags[words.first[doc] + span["start"] : words.first[doc] + span["end"]] = True
                found = [pa.array(words.counts, pa.int64()), pa.array(per_doc(flags, words.first), pa.int64()), runs(flags, words.first), pa.array([sorted(x) for x in items], pa.list_(pa.string()))]
                yield appended(batch, ["n_words", "n_hit", "spans", "item_ids"], found)

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name not in ("n_words", "n_hit", "spans", "item_ids")]
    return docs.mapInArrow(scan, ", ".join([*kept, FOUND]))


def scan(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Adds n_words, n_hit, spans of hit words and item_ids (sorted) to the documents."""
    small_batches(docs.sparkSession)
    found = item_windows(benchmark, size)
    total = found.agg(F.sum(F.octet_length("phrase") + F.octet_length("item_id") + 64)).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    for block in range(blocks):
        part = found if blocks == 1 else found.where(F.pmod(F.xxhash64("phrase"), F.lit(blocks)) == block)
        docs = _scan_block(docs, [tuple(r) for r in part.collect()], text, merge=block > 0)
        if block < blocks - 1:
            docs = cut(docs)
    return docs


def remove_documents(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, text: str = "text") -> DataFrame:
    """The documents without a hit, with their own columns."""
    return scan(docs, benchmark, size, text).where("n_hit = 0").select(*docs.columns)


def remove_spans(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, text: str = "text") -> DataFrame:
    """All documents, each text without its hit words and what stands between them."""

    def blank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, (raw, _) = split_words(batch.column(text), ALNUM, lower=True), column_bytes(batch.column(text))
            texts, spans = batch.column(text).to_pylist(), batch.column("spans").to_pylist()
            _, offsets = column_bytes(batch.column(text))
            for doc, own in enumerate(spans):
                if own:
                    at, out = int(offsets[doc]), []
                    for span in own:
                        a, b = words.first[doc] + span["start"], words.first[doc] + span["end"] - 1
                        out.append(raw[at : words.starts[a]].tobytes())
                        at = int(words.ends[b])
                    texts[doc] = b"".join([*out, raw[at : int(offsets[doc + 1])].tobytes()]).decode()
            yield batch.set_column(batch.schema.get_field_index(text), text, pa.array(texts, batch.schema.field(text).type))

    found = scan(docs, benchmark, size, text)
    return found.mapInArrow(blank, found.schema).select(*docs.columns)
