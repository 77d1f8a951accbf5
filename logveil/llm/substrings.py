"""Substring dedup by relative Lempel-Ziv parsing.

The reference is the whole corpus, cut into blocks of bounded bytes.  Its index holds
where phrases (runs of `window` words) start: the first and the last place, as block and
word number.  Every document is factored greedily against the index: a factor begins at a
word whose phrase also starts elsewhere, takes that place as its source, and grows by a
word as long as the next phrase's source is the next word of the same block.  A factor has
a source and a length of at least `window` words.  The next factor may begin one word
after the last phrase of the one before, so phrases that lie across the boundary of two
factors are looked up like all others.  At its source block each factor's words are
compared with the reference by a 128-bit digest of their bytes; words of a confirmed
factor are duplicate spans.

To keep the index small, phrases are looked up only where their anchor is shared: the
leftmost smallest of the phrase's runs of `window // 2` words.  Equal phrases have equal
anchors at equal offsets, so a phrase whose anchor stands nowhere else is unique.

Plan: documents are dealt into blocks once (one shuffle of the text) and read from there
by each step.  A block sends each range of hashes its distinct anchors, and later the
distinct phrases with shared anchors, so what is everywhere costs an entry per block and
no key's rows meet in one task.  Blocks and ranges grow with the corpus beyond
`exchange.MOST_PIECES` of them.

Defined results: a null or wordless text has no words, no spans and an empty kept text;
texts of fewer words than a window have nothing to remove; all copies of a phrase go, the
first included, and repeated rows are copies of each other; a factor whose words differ
from its source (a 64-bit collision) removes nothing; doc_id may be null or of any type;
an empty table gives an empty result; other columns are not carried.
"""

from __future__ import annotations

import hashlib
from itertools import compress
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logveil.llm.arrowcols import SPANS, per_doc, runs
from logveil.llm.exchange import CHUNK_BYTES, bounds, distinct, extent, partitions, pieces, small_batches
from logveil.llm.textbytes import Words, column_bytes, mix, rolled, split_words

WINDOW = 35


class Parsed(NamedTuple):
    """The words of a block and its phrases."""

    words: Words
    at: np.ndarray  # where phrases start
    anchors: np.ndarray  # distinct anchors of the block, in order
    twice: np.ndarray  # whether each stands at two places of the block
    own: np.ndarray  # for each phrase, the number of its anchor


def _parsed(table: pa.Table, window: int) -> Parsed:
    words = split_words(table.column("text"))
    size = max(1, window // 2)
    at = np.flatnonzero(words.room() >= window)
    if not len(at):
        return Parsed(words, at, np.zeros(0, np.uint64), np.zeros(0, dtype=bool), np.zeros(0, np.int64))
    grams = mix(rolled(words.hashes, size), 17)
    least, place = _leftmost(grams, window - size + 1)
    chosen = place[at]
    fresh = np.ones(len(chosen), dtype=bool)
    fresh[1:] = chosen[1:] != chosen[:-1]
    anchors, twice = distinct(grams[chosen[fresh]])
    return Parsed(words, at, anchors, twice, np.searchsorted(anchors, least[at]))


def _leftmost(values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The smallest of each run of `width` values, and its leftmost place."""
    least, place, span = values, np.arange(len(values)), 1

    def joined(shift: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(least) - shift
        right = least[shift:] < least[:n]
        return np.where(right, least[shift:], least[:n]), np.where(right, place[shift:], place[:n])

    while span * 2 <= width:
        least, place = joined(span)
        span *= 2
    return joined(width - span) if width > span else (least, place)


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def _flags(bits: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)


def _rows(schema: str, rows: list[tuple]) -> pa.Table:
    """Rows of ints and bytes as a table."""
    kinds = {"int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.table({name: pa.array([r[i] for r in rows], kinds[kind]) for i, (name, kind) in enumerate(fields)})


def _words_of(parsed: Words, start: int, n: int) -> bytes:
    return b" ".join(parsed.data[parsed.starts[start] : parsed.ends[start + n - 1]].tobytes().split())


_ASKED = "chunk int, part int, hashes binary, flags binary"
_TOLD = "chunk int, part int, kind int, payload binary"
_PHRASES = "chunk int, part int, hashes binary, places binary, spread binary"
_FACTOR = np.dtype([("start", "<u4"), ("n", "<u4"), ("block", "<u4"), ("source", "<u4"), ("ask", "<u4")])
_ASK = np.dtype([("source", "<u4"), ("n", "<u4"), ("digest", "V16")])
_ANCHORS, _SOURCES, _FACTORS, _ASKS, _ANSWERS = range(5)


def parse(docs: DataFrame, window: int = WINDOW, text: str = "text", id: str = "doc_id", block_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Per document: its id (named doc_id), n_words, n_removed, spans (of word numbers) and kept_text."""
    spark, source = docs.sparkSession, docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    small_batches(spark)
    size = extent(source)
    chunks = pieces(size.bytes, block_bytes)
    bits = (chunks - 1).bit_length()
    n_parts, n_ranges = partitions(spark, chunks), partitions(spark, 1 << bits)
    keyed = source.withColumn("row", F.xxhash64("doc_id", "text"))
    dealt = keyed.withColumn("chunk", F.pmod("row", F.lit(chunks)).cast("int")).repartition(n_parts, "chunk")

    def ordered(table: pa.Table) -> pa.Table:
        """A block's rows in the order in which every step sees them; rows with equal keys are equal."""
        return table.take(pa.array(np.argsort(table.column("row").to_numpy(), kind="stable")))

    def ask(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        block = _parsed(ordered(table), window)
        edges = bounds(block.anchors, bits)
        return _rows(_ASKED, [(key[0].as_py(), r, block.anchors[a:b].tobytes(), _bits(block.twice[a:b])) for r, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if b > a])

    def share(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """One bit for each anchor asked for: whether it stands at two places or more."""
        parts = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
        twice = [_flags(x, len(p)) for x, p in zip(table.column("flags").to_pylist(), parts, strict=True)]
        keys, several = distinct(np.concatenate(parts))
        several[np.searchsorted(keys, np.concatenate([p[t] for p, t in zip(parts, twice, strict=True)]))] = True
        told = [_bits(several[np.searchsorted(keys, own)]) for own in parts]
        return _rows(_TOLD, [(c, key[0].as_py(), _ANCHORS, x) for c, x in zip(table.column("chunk").to_pylist(), told, strict=True)])

    def candidates(table: pa.Table, told: pa.Table) -> tuple[Words, np.ndarray, np.ndarray]:
        """A block's phrases with shared anchors: places and hashes."""
        block = _parsed(table, window)
        edges = bounds(block.anchors, bits)
        shared = np.zeros(len(block.anchors), dtype=bool)
        for part, kind, payload in zip(*(told.column(c).to_pylist() for c in ("part", "kind", "payload")), strict=True):
            if kind == _ANCHORS:
                shared[edges[part] : edges[part + 1]] = _flags(payload, edges[part + 1] - edges[part])
        at = block.at[shared[block.own]]
        return block.words, at, mix(rolled(block.words.hashes, window)[at], 19) if len(at) else np.zeros(0, np.uint64)

    def phrases(at: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, ...]:
        """Distinct phrases by range, then in order of their first place: range, hash, first and last place."""
        order = np.argsort(hashes, kind="stable")
        edge = np.flatnonzero(np.concatenate(([True], np.diff(hashes[order]) != 0))) if len(order) else order
        last = np.append(edge[1:], len(order)) - 1 if len(order) else order
        known, low, high = hashes[order[edge]], at[order[edge]], at[order[last]]
        part = known >> np.uint64(64 - bits) if bits else np.zeros(len(known), np.uint64)
        order = np.lexsort((low, part))
        return part[order].astype(np.int64), known[order], low[order], high[order]

    def look_up(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _rows(_PHRASES, [])
        part, known, low, high = phrases(*candidates(ordered(left), right)[1:])
        edges = np.searchsorted(part, np.arange((1 << bits) + 1))
        steps = lambda a, b: np.diff(low[a:b], prepend=0).astype("<u4").tobytes()
        return _rows(_PHRASES, [(key[0].as_py(), r, known[a:b].tobytes(), steps(a, b), (high[a:b] - low[a:b]).astype("<u4").tobytes()) for r, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if b > a])

    def index(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """The range's first and last place of every phrase; each block is told both for its phrases that have two places.

        Places are told as steps from the block's own first place, which stay alike along a copied passage.
        """
        blocks = table.column("chunk").to_numpy()
        parts = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
        low = [np.cumsum(np.frombuffer(x, "<u4"), dtype=np.int64) for x in table.column("places").to_pylist()]
        high = [a + np.frombuffer(x, "<u4") for a, x in zip(low, table.column("spread").to_pylist(), strict=True)]
        keys = distinct(np.concatenate(parts))[0]
        where = [np.searchsorted(keys, own) for own in parts]
        first, final = np.full(len(keys), np.iinfo(np.int64).max), np.full(len(keys), -1)
        for block, own, a, b in zip(blocks.tolist(), where, low, high, strict=True):
            first[own] = np.minimum(first[own], (block << 32) + a)
            final[own] = np.maximum(final[own], (block << 32) + b)
        rows: list[tuple] = []
        for block, own, a in zip(blocks.tolist(), where, low, strict=True):
            shared = first[own] != final[own]
            here = a[shared]
            x, y = first[own][shared], final[own][shared]
            y = np.where(x >> 32 == block, y, x)  # the last place is of use only to the block of the first
            told = [_bits(shared)] + [v.tobytes() for p in (x, y) for v in ((p >> 32).astype("<u4"), ((p & 0xFFFFFFFF) - here).astype("<i8").astype("<u4"))]
            rows.append((block, key[0].as_py(), _SOURCES, b"".join(told)))
        return _rows(_TOLD, rows)

    def factor(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        """The greedy parse of a block's documents: its factors, and what it asks of their source blocks."""
        if not left.num_rows:
            return _rows(_TOLD, [])
        chunk = key[0].as_py()
        words, at, hashes = candidates(ordered(left), right)
        part, known, low, _ = phrases(at, hashes)
        edges = np.searchsorted(part, np.arange((1 << bits) + 1))
        sources = np.full((2, len(known)), -1, np.int64)
        for r, kind, payload in zip(*(right.column(c).to_pylist() for c in ("part", "kind", "payload")), strict=True):
            if kind == _SOURCES:
                a, b = edges[r], edges[r + 1]
                shared = np.flatnonzero(_flags(payload, b - a)) + a
                body = np.frombuffer(payload, "<u4", offset=-(-(b - a) // 8)).reshape(4, len(shared))
                for k in (0, 1):
                    sources[k, shared] = (body[2 * k].astype(np.int64) << 32) + ((body[2 * k + 1].astype(np.int64) + low[shared]) & 0xFFFFFFFF)
        order = np.argsort(known)
        mine = order[np.searchsorted(known[order], hashes)] if len(known) else np.zeros(0, np.int64)
        place = (chunk << 32) + at
        source = np.where(sources[0, mine] == place, sources[1, mine], sources[0, mine])
        at, source = at[source >= 0], source[source >= 0]
        if not len(at):
            return _rows(_TOLD, [])
        begins = np.flatnonzero(np.concatenate(([True], (np.diff(at) != 1) | (np.diff(source) != 1))))
        factors = np.zeros(len(begins), _FACTOR)
        factors["start"], factors["n"] = at[begins], np.diff(np.append(begins, len(at))) + window - 1
        factors["block"], factors["source"] = source[begins] >> 32, source[begins] & 0xFFFFFFFF
        asks: dict[int, dict[tuple[int, int, bytes], int]] = {}
        for i, (start, n, block, at_source, _) in enumerate(factors.tolist()):
            digest = hashlib.blake2b(_words_of(words, start, n), digest_size=16).digest()
            own = asks.setdefault(block, {})
            factors["ask"][i] = own.setdefault((at_source, n, digest), len(own))
        rows: list[tuple] = [(chunk, chunk, _FACTORS, factors.tobytes())]
        for block, own in asks.items():
            packed = b"".join(np.array([a, n], "<u4").tobytes() + digest for a, n, digest in own)
            rows.append((block, chunk, _ASKS, packed))
        return _rows(_TOLD, rows)

    def confirm(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        """A block's answers: whether its words at a factor's source are the factor's words."""
        asked = [(c, np.frombuffer(x, _ASK)) for c, kind, x in zip(*(right.column(n).to_pylist() for n in ("part", "kind", "payload")), strict=True) if kind == _ASKS]
        if not asked or not left.num_rows:
            return _rows(_TOLD, [])
        words, known = split_words(ordered(left).column("text")), {}
        rows: list[tuple] = []
        for chunk, requests in asked:
            right_ones = []
            for at_source, n, digest in zip(requests["source"].tolist(), requests["n"].tolist(), requests["digest"], strict=True):
                if (at_source, n) not in known:
                    known[at_source, n] = hashlib.blake2b(_words_of(words, at_source, n), digest_size=16).digest()
                right_ones.append(known[at_source, n] == digest.tobytes())
            rows.append((chunk, key[0].as_py(), _ANSWERS, _bits(np.array(right_ones, dtype=bool))))
        return _rows(_TOLD, rows)

    def remove(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        left = ordered(left)
        words = split_words(left.column("text"))
        told = list(zip(*(right.column(n).to_pylist() for n in ("part", "kind", "payload")), strict=True))
        answers = {block: np.unpackbits(np.frombuffer(x, np.uint8)).astype(bool) for block, kind, x in told if kind == _ANSWERS}
        edges = np.zeros(len(words.hashes) + 1, np.int64)
        for _, kind, payload in told:
            if kind == _FACTORS:
                factors = np.frombuffer(payload, _FACTOR)
                sure = np.array([answers[b][a] for b, a in zip(factors["block"].tolist(), factors["ask"].tolist(), strict=True)], dtype=bool)
                start, n = factors["start"][sure].astype(np.int64), factors["n"][sure].astype(np.int64)
                np.add.at(edges, start, 1)
                np.subtract.at(edges, start + n, 1)
        gone = np.cumsum(edges[:-1]) > 0
        raw, offsets = column_bytes(left.column("text"))
        raw, kept = raw.tobytes(), []
        removed = per_doc(gone, words.first)
        for doc in range(left.num_rows):
            own = raw[offsets[doc] : offsets[doc + 1]].split()
            if removed[doc]:
                own = compress(own, (~gone[words.first[doc] : words.first[doc + 1]]).tolist())
            kept.append(b" ".join(own))
        return pa.table({
            "doc_id": left.column("doc_id"),
            "n_words": pa.array(words.counts, pa.int64()),
            "n_removed": pa.array(removed, pa.int64()),
            "spans": runs(gone, words.first),
            "kept_text": pa.array(kept, pa.binary()).cast(pa.string()),
        })

    by_chunk = dealt.groupBy("chunk")
    anchors = by_chunk.applyInArrow(ask, _ASKED).repartition(n_ranges, "part").groupBy("part").applyInArrow(share, _TOLD)
    looked = by_chunk.cogroup(anchors.repartition(n_parts, "chunk").groupBy("chunk")).applyInArrow(look_up, _PHRASES)
    sources = looked.repartition(n_ranges, "part").groupBy("part").applyInArrow(index, _TOLD)
    told = anchors.unionByName(sources).repartition(n_parts, "chunk")
    factors = by_chunk.cogroup(told.groupBy("chunk")).applyInArrow(factor, _TOLD).repartition(n_parts, "chunk")
    answers = by_chunk.cogroup(factors.groupBy("chunk")).applyInArrow(confirm, _TOLD)
    verdicts = factors.where(F.col("kind") == _FACTORS).unionByName(answers).repartition(n_parts, "chunk")
    id_type = source.schema["doc_id"].dataType.simpleString()
    return by_chunk.cogroup(verdicts.groupBy("chunk")).applyInArrow(remove, f"doc_id {id_type}, n_words long, n_removed long, spans {SPANS}, kept_text string")
