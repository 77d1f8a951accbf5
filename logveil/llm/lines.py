"""Line dedup by a segment-partition edit join.

A line is a non-empty run of bytes between line feeds.  Lines of at least
`least` bytes that are within `most` edits (in UTF-8 bytes) of each other are
near copies.  Two such lines share one of `most + 1` segments of the shorter
line, at a place that their lengths narrow down:

* every line gives signatures of its own segments (the index) and of the few
  substrings that could equal a segment of a line of its length or up to `most`
  bytes less (the probes); a signature names the length, the segment and its bytes;
* signatures are compared within ranges of their hash, packed by tasks; two lines of
  a signature are candidates if their sketches (parities of their bytes' counts in 32
  buckets, of which an edit changes two at most) allow it;
* a signature of more than `GROUP` lines is dealt out again: sketches that differ in
  at most 2 * most bits agree on one of 2 * most + 1 blocks of bits, so its lines meet
  by signature and block, and none of their pairs is lost or made without need;
* candidates are verified by banded bit-parallel edit distance on the lines.

A line is dropped where the same line stands earlier (by doc_id, then line
number), and everywhere if a near copy first stands earlier.  Shorter lines carry
too little to be judged and stay.

Plan: documents are scanned for signatures and for line numbers; the text is
shuffled once by doc_id and read by the step that fetches candidate lines and by
the last step.  Equal lines of a task give one entry, so a frequent line costs an
entry per task and map-side aggregation its rows.

Defined results: a null text has no lines and stays null; empty lines stay; doc_id may
be of any type (integers in their order, others in that of their hashes), and rows
without one stand after all others; rows that share a doc_id are documents in the order
of a hash of their texts, and repeated rows are one document and treated alike; an empty
table gives an empty result; the documents' other columns are carried, and give way
where they clash with the new ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logveil.llm.arrowcols import appended, fresh_name
from logveil.llm.editdistance import within
from logveil.llm.exchange import cut, extent, few, partitions, pieces, small_batches
from logveil.llm.textbytes import Words, mix, powers, slices, split_words

MOST = 2
LEAST = 40
#: Lines of one signature that are compared with each other at once.
GROUP = 64
#: Text bytes whose signatures make up one range, on average.
RANGE_TEXT = 8 << 20
_LINE_BYTES = np.ones(256, dtype=bool)
_LINE_BYTES[10] = False
_ENTRY = np.dtype([("sig", "<u8"), ("id", "<u8"), ("sketch", "<u4")])
_BUCKET = (np.uint64(1) << (mix(np.arange(256, dtype=np.uint64), 71) & np.uint64(31))).astype(np.uint32)


def split_lines(column) -> Words:
    """Non-empty lines of a string column with their hashes."""
    return split_words(column, _LINE_BYTES)


def _segments(length: np.ndarray, count: int, index: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and size of a segment when a length is split into `count` segments as even as can be."""
    size, longer = length // count, length % count
    begin = index * size + np.maximum(0, index - (count - longer))
    return begin, size + (index >= count - longer)


def signatures(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Signature entries of the lines data[start:end]; starts are in order."""
    if not len(starts):
        return np.empty(0, _ENTRY)
    length = ends - starts
    longest = int(length.max())
    power, inverse = powers(longest + 1), _inverse_powers(longest + 1)
    place = np.arange(len(data)) - np.repeat(np.append(0, starts), np.diff(np.concatenate(([0], starts, [len(data)]))))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data + np.uint64(1)) * power[np.minimum(place, longest)], dtype=np.uint64)))
    bounds = np.stack((starts, ends), axis=1).ravel()
    sketch = np.bitwise_xor.reduceat(np.append(_BUCKET[data], np.uint32(0)), bounds)[::2]
    out = []
    for delta in range(most + 1):
        target = length - delta
        for i in range(most + 1):
            begin, size = _segments(target, most + 1, i)
            low = np.maximum.reduce([np.zeros_like(begin), begin - i, begin + delta - (most - i)])
            high = np.minimum.reduce([length - size, begin + i, begin + delta + (most - i)])
            for shift in range(-most, most + 1):
                at = begin + shift
                rows = np.flatnonzero((size > 0) & (at >= low) & (at <= high))
                a = at[rows]
                raw = (sums[starts[rows] + a + size[rows]] - sums[starts[rows] + a]) * inverse[a]
                entry = np.empty(len(rows), _ENTRY)
                entry["sig"] = mix(raw ^ mix((target[rows] * 8 + i).astype(np.uint64), 31))
                entry["id"], entry["sketch"] = ids[rows], sketch[rows]
                out.append(entry)
    return np.concatenate(out)


def _inverse_powers(n: int) -> np.ndarray:
    multiplier = int(powers(2)[1])
    out = np.full(n, pow(multiplier, -1, 1 << 64), np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _packed(entries: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    """Entries by range of their signature."""
    entries = entries[np.argsort(entries["sig"])]
    edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits) if bits else np.zeros(0, np.uint64)
    bounds = np.concatenate(([0], np.searchsorted(entries["sig"], edges), [len(entries)]))
    filled = np.flatnonzero(np.diff(bounds))
    yield pa.RecordBatch.from_arrays([pa.array(filled, pa.int32()), pa.array([entries[bounds[r] : bounds[r + 1]].tobytes() for r in filled], pa.binary())], names=["range", "entries"])


def _blocks(entries: np.ndarray, most: int) -> np.ndarray:
    """Each entry once for every block of its sketch's bits, under a signature for the block."""
    edges = np.linspace(0, 32, 2 * most + 2).astype(int)
    out = []
    for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        bits = (entries["sketch"].astype(np.uint64) >> np.uint64(a)) & np.uint64((1 << int(b - a)) - 1)
        part = entries.copy()
        part["sig"] = mix(entries["sig"] ^ mix(bits * np.uint64(64) + np.uint64(k), 41))
        out.append(part)
    return np.concatenate(out)


def _pairs(group: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a signature's lines (in order of their ids) whose sketches allow it."""
    left, right = [], []
    for at in range(0, len(group), 256):
        rows, rest = group["sketch"][at : at + 256], group["sketch"][at + 1 :]
        far = np.bitwise_count(rows[:, None] ^ rest[None, :])
        x, y = np.nonzero(np.triu(far <= 2 * most))
        left.append(group["id"][at + x])
        right.append(group["id"][at + 1 + y])
    return np.concatenate(left), np.concatenate(right)


def _joined(table: pa.Table, most: int, bits: int, again: bool) -> pa.Table:
    """Entries of one range to candidate pairs (a, b); with again, signatures of many lines are packed for another round."""
    entries = np.concatenate([np.frombuffer(x, _ENTRY) for x in table.column("entries").to_pylist()])
    entries = entries[np.lexsort((entries["id"], entries["sig"]))]
    fresh = np.ones(len(entries), dtype=bool)
    fresh[1:] = (entries["sig"][1:] != entries["sig"][:-1]) | (entries["id"][1:] != entries["id"][:-1])
    entries = entries[fresh]
    edges = np.flatnonzero(np.concatenate(([True], entries["sig"][1:] != entries["sig"][:-1], [True])))
    size = np.diff(edges)
    large = size > GROUP if again else np.zeros(len(size), dtype=bool)
    pair = np.empty((2, 0), np.uint64)
    for g in np.flatnonzero((size > 1) & ~large).tolist():
        if size[g] == 2:
            continue
        pair = np.concatenate((pair, np.stack(_pairs(entries[edges[g] : edges[g + 1]], most))), axis=1)
        if pair.shape[1] > 1 << 20:
            pair = np.unique(pair, axis=1)
    two = edges[:-1][size == 2]
    near = np.bitwise_count(entries["sketch"][two] ^ entries["sketch"][two + 1]) <= 2 * most
    pair = np.unique(np.concatenate((pair, np.stack((entries["id"][two[near]], entries["id"][two[near] + 1]))), axis=1), axis=1)
    out = pa.table({"a": pa.array(pair[0].view(np.int64)), "b": pa.array(pair[1].view(np.int64)), "range": pa.nulls(pair.shape[1], pa.int32()), "entries": pa.nulls(pair.shape[1], pa.binary())})
    if large.any():
        many = _blocks(entries[np.repeat(large, size)], most)
        for packed in _packed(many, bits):
            more = pa.table(packed)
            out = pa.concat_tables([out, pa.table({"a": pa.nulls(more.num_rows, pa.int64()), "b": pa.nulls(more.num_rows, pa.int64()), "range": more.column("range"), "entries": more.column("entries")})])
    return out


_JOINED = "a long, b long, range int, entries binary"


def _order(docs: DataFrame) -> Column:
    """The place of a document among all by its id: those without one last, ids that are no integers by their hashes."""
    whole = isinstance(docs.schema["doc_id"].dataType, T.IntegralType)
    id = F.col("doc_id").cast("long") if whole else F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id"))
    return F.coalesce(id, F.lit(2**63 - 1))


def _row() -> Column:
    """What documents are dealt out and joined by, and their order where their ids are equal."""
    return F.xxhash64("doc_id", "text")


class LineJoin:
    """The steps of one run over documents (doc_id, text)."""

    def __init__(self, docs: DataFrame, most: int = MOST, least: int = LEAST):
        self.spark, self.most, self.least = docs.sparkSession, most, least
        small_batches(self.spark)
        self.source = docs.select(_order(docs).alias("place"), _row().alias("row"), "text")
        size = extent(self.source)
        self.bits = (pieces(size.bytes, RANGE_TEXT) - 1).bit_length()
        self.parts = partitions(self.spark, pieces(size.bytes))
        self.key = fresh_name(docs.columns, "_key")
        self.dealt = docs.withColumn(self.key, _row()).repartition(self.parts, self.key)

    def numbered(self) -> DataFrame:
        """Every judged line, once for each document: (id, place and row of the document, first line that is it)."""
        least = self.least

        def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in slices(whole):
                    lines = split_lines(batch.column("text"))
                    keep = np.flatnonzero(lines.ends - lines.starts >= least)
                    doc = np.repeat(np.arange(batch.num_rows), lines.counts)[keep]
                    order = np.lexsort((keep, lines.hashes[keep], doc))
                    keep, doc = keep[order], doc[order]
                    fresh = np.ones(len(keep), dtype=bool)
                    fresh[1:] = (doc[1:] != doc[:-1]) | (lines.hashes[keep[1:]] != lines.hashes[keep[:-1]])
                    keep, doc = keep[fresh], doc[fresh]
                    yield pa.RecordBatch.from_arrays([pa.array(lines.hashes[keep].view(np.int64)), batch.column("place").take(pa.array(doc)), batch.column("row").take(pa.array(doc)), pa.array(keep - lines.first[doc], pa.int32())], names=["id", "place", "row", "line"])

        return self.source.mapInArrow(number, "id long, place long, row long, line int")

    def candidates(self) -> DataFrame:
        """Candidate pairs (a, b) of all lines by their ids."""
        least, most, bits = self.least, self.most, self.bits

        def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in slices(whole):
                    lines = split_lines(batch.column("text"))
                    _, at = np.unique(lines.hashes, return_index=True)
                    at = np.sort(at[(lines.ends - lines.starts)[at] >= least])
                    yield from _packed(signatures(lines.data, lines.starts[at], lines.ends[at], lines.hashes[at], most), bits)

        def first(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            return _joined(table, most, bits, again=True)

        def second(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            return _joined(table, most, bits, again=False)

        n = partitions(self.spark, 1 << bits)
        found = cut(self.source.mapInArrow(sign, "range int, entries binary").repartition(n, "range").groupBy("range").applyInArrow(first, _JOINED))
        large = found.where("range is not null").select("range", "entries").repartition(n, "range").groupBy("range").applyInArrow(second, _JOINED)
        return found.where("range is null").select("a", "b").unionByName(large.select("a", "b")).distinct()

    def texts(self, wanted: DataFrame) -> DataFrame:
        """Lines (id, row of a document) to (id, body), read from those documents."""

        def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in slices(whole):
                    lines, ids = split_lines(batch.column("text")), batch.column("ids")
                    offsets = np.asarray(ids.offsets) - ids.offsets[0].as_py()
                    flat = np.asarray(ids.flatten())
                    out_id, out_body = [], []
                    hashes = lines.hashes.view(np.int64)
                    for doc in range(batch.num_rows):
                        own = flat[offsets[doc] : offsets[doc + 1]]
                        a, b = lines.first[doc], lines.first[doc + 1]
                        places = {h: i for i, h in enumerate(hashes[a:b].tolist(), a)}
                        for h in own.tolist():
                            if (at := places.get(h)) is not None:
                                out_id.append(h)
                                out_body.append(lines.data[lines.starts[at] : lines.ends[at]].tobytes())
                    yield pa.RecordBatch.from_arrays([pa.array(out_id, pa.int64()), pa.array(out_body, pa.binary())], names=["id", "body"])

        by_doc = wanted.groupBy("row").agg(F.collect_set("id").alias("ids")).repartition(self.parts, "row")
        joined = self.dealt.select(F.col(self.key).alias("at"), "text").join(by_doc, F.col("at") == F.col("row")).select("text", "ids")
        return joined.mapInArrow(pick, "id long, body binary").dropDuplicates(["id"])


def verified(pairs: DataFrame, texts: DataFrame, most: int) -> DataFrame:
    """The pairs of line ids whose lines are within `most` edits and differ."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = within(batch.column("x").to_pylist(), batch.column("y").to_pylist(), most)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    x = texts.select(F.col("id").alias("a"), F.col("body").alias("x"))
    y = texts.select(F.col("id").alias("b"), F.col("body").alias("y"))
    return pairs.join(x, "a").join(y, "b").mapInArrow(check, "a long, b long")


def near_lines(join: LineJoin, first: DataFrame) -> DataFrame:
    """Links (a, b) between lines by their ids; first: (id, first occurrence) of all lines."""
    pairs = cut(join.candidates())
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    texts = join.texts(first.join(ids, "id").select("id", F.col("first.row").alias("row")))
    return verified(pairs, texts, join.most)


def dedup(docs: DataFrame, most: int = MOST, least: int = LEAST) -> DataFrame:
    """The documents with duplicate lines taken out of `text`.

    Adds n_lines (non-empty), n_removed, n_near (removed as near copies) and n_links (of its lines' near copies).
    """
    join = LineJoin(docs, most, least)
    numbered = cut(join.numbered())
    first = cut(numbered.groupBy("id").agg(F.min(F.struct("place", "row", "line")).alias("first"), F.max(F.struct("place", "row")).alias("last")))
    home = F.struct(F.col("first.place").alias("place"), F.col("first.row").alias("row"))
    links = cut(near_lines(join, first))
    both = links.union(links.select("b", "a")).toDF("id", "other")
    ordered = both.join(first.select("id", "first"), "id").join(first.select(F.col("id").alias("other"), F.col("first").alias("before")), "other")
    near = ordered.groupBy("id").agg(F.max(F.col("before") < F.col("first")).alias("near"), F.count(F.lit(1)).alias("links"))
    told = first.join(near, "id", "left").where(F.col("links").isNotNull() | (F.col("last") > home))
    told = told.select("id", home.alias("home"), F.coalesce("near", F.lit(False)).alias("near"), F.coalesce("links", F.lit(0)).alias("links"))
    # a line that stands in very many documents is a key of one row on the other side
    marks = numbered.select("id", F.struct("place", "row").alias("key")).join(few(cut(told)), "id").where((F.col("key") != F.col("home")) | (F.col("links") > 0))
    mark = F.struct("id", ((F.col("key") != F.col("home")) | F.col("near")).alias("gone"), "near", "links")
    marks_name, at = fresh_name(docs.columns, "_marks"), fresh_name(docs.columns, "_at")
    by_doc = marks.groupBy(F.col("key.row").alias(at)).agg(F.collect_list(mark).alias(marks_name)).repartition(join.parts, at)

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                lines, texts = split_lines(batch.column("text")), batch.column("text").to_pylist()
                hashes, long = lines.hashes.view(np.int64).tolist(), (lines.ends - lines.starts >= least).tolist()
                removed, near, linked = [], [], []
                for doc, marks in enumerate(batch.column(marks_name).to_pylist()):
                    told = {m["id"]: m for m in marks or ()}
                    seen: set[int] = set()
                    drop, n_near, n_links = set(), 0, 0
                    for line in range(lines.first[doc], lines.first[doc + 1]):
                        if not long[line]:
                            continue
                        mark = told.get(hashes[line])
                        n_links += mark["links"] if mark else 0
                        if hashes[line] in seen or (mark and mark["gone"]):
                            drop.add(line - lines.first[doc])
                            n_near += bool(mark and mark["near"])
                        seen.add(hashes[line])
                    if drop:
                        kept, n = [], 0
                        for line in texts[doc].split("\n"):
                            if line == "" or n not in drop:
                                kept.append(line)
                            n += line != ""
                        texts[doc] = "\n".join(kept)
                    removed.append(len(drop))
                    near.append(n_near)
                    linked.append(n_links)
                cleaned = batch.drop_columns([marks_name])
                cleaned = cleaned.set_column(cleaned.schema.get_field_index("text"), "text", pa.array(texts, cleaned.schema.field("text").type))
                yield appended(cleaned, list(_ADDED), [pa.array(lines.counts, pa.int64()), *(pa.array(x, pa.int64()) for x in (removed, near, linked))])

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name not in _ADDED]
    joined = join.dealt.join(by_doc, F.col(join.key) == F.col(at), "left").select(*docs.columns, marks_name)
    return joined.mapInArrow(rebuild, ", ".join([*kept, *(f"{c} long" for c in _ADDED)]))


_ADDED = ("n_lines", "n_removed", "n_near", "n_links")
