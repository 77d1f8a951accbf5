"""Byte-level BPE encoding and decoding with overlapping chunks.

A text of more than `chunk` characters is cut into chunks that overlap by
`overlap` characters.  Chunks are dealt out and pre-tokenised in parallel, each
from its own first character, which may stand inside a token.  A match of the
pattern depends on nothing before its start, so once a chunk has a boundary that
its predecessor has too, both have the same boundaries from there on: that place
is the seam.  Each chunk then encodes its pieces between two seams, and the ids of
a text are put together in order.  Texts with a pair of chunks that never agree
within the overlap (a run of one class longer than the overlap) are encoded in one
piece.  Shorter texts are one chunk and are not shuffled.

Decoding concatenates the raw bytes of the ids.

Ids are little-endian unsigned 32-bit integers in a binary column.  Ranks and
pattern are those of a public vocabulary file, whose path is a parameter; its
content goes to the executors in a broadcast of that file's size.

Defined results: a null text is empty and has no ids; special tokens are ordinary
text; repeated rows get equal ids; an empty table gives an empty result; the
columns of the input are carried, and give way where they clash with new ones.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logveil.llm.arrowcols import appended, fresh_name
from logveil.llm.exchange import cut, partitions, small_batches
from logveil.llm.textbytes import slices

CHUNK = 1 << 15
OVERLAP = 1 << 10
#: Distinct pieces whose ids a worker remembers.
REMEMBERED = 100_000
#: Pieces at the end of a chunk that its cut end may have changed.
_UNSURE = 2


def vocabulary_bytes(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def ranks_of(vocabulary: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in vocabulary.splitlines() if line)}


class PieceEncoder(dict):
    """Pieces of the pattern to their ids as little-endian 32-bit integers."""

    def __init__(self, vocabulary: bytes, pattern: str = public_tokenizers.PATTERN):
        super().__init__()
        ranks = ranks_of(vocabulary)
        self._merge = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.split = regex.compile(pattern).findall

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        ids = np.array(self._merge(piece), "<u4").tobytes()
        if len(piece) < 64:
            self[piece] = ids
        return ids

    def count(self, piece: str) -> int:
        """Tokens of a piece."""
        return len(self._merge(piece))

    def encode(self, text: str) -> bytes:
        return b"".join([self[p] for p in self.split(text)])

    def boundaries(self, text: str) -> np.ndarray:
        """Where the pieces of a text begin."""
        return np.concatenate(([0], np.cumsum([len(p) for p in self.split(text)])))[:-1].astype(np.int64)


class Decoder:
    """Token ids to bytes; it needs no encoder."""

    def __init__(self, vocabulary: bytes):
        ranks = ranks_of(vocabulary)
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_encoders: dict[bytes, PieceEncoder] = {}


def encoder_of(vocabulary) -> PieceEncoder:
    """The worker's encoder for a broadcast vocabulary; tasks of one worker share what it remembers."""
    content = vocabulary.value
    name = hashlib.sha256(content).digest()
    if name not in _encoders:
        _encoders[name] = PieceEncoder(content)
    return _encoders[name]


def with_columns(df: DataFrame, new: dict[str, str]) -> str:
    """Schema of a table with more columns at its end; one of the same name gives way."""
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name not in new] + [f"{k} {v}" for k, v in new.items()])


def broadcast_vocabulary(spark: SparkSession, path: str | None):
    small_batches(spark)
    return spark.sparkContext.broadcast(vocabulary_bytes(path or public_tokenizers.path("byte_bpe_50k.tiktoken")))


def encode(docs: DataFrame, text: str = "text", path: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Adds token_ids (binary) and n_tokens to the documents."""
    vocabulary = broadcast_vocabulary(docs.sparkSession, path)

    def encode_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(vocabulary)
        for whole in batches:
            for batch in slices(whole):
                ids = [encoder.encode(x) if x else b"" for x in batch.column(text).to_pylist()]
                yield appended(batch, ["token_ids", "n_tokens"], [pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())])

    new = {"token_ids": "binary", "n_tokens": "long"}
    length = F.coalesce(F.length(text), F.lit(0))
    short = docs.where(length <= chunk).mapInArrow(encode_rows, with_columns(docs, new))
    # equal rows have equal keys and equal ids
    names = [fresh_name(docs.columns, k) for k in ("__k1", "__k2", "__k3")]
    keyed = docs.where(length > chunk).withColumn(names[0], F.xxhash64(text)).withColumn(names[1], F.xxhash64(F.lit(1), text))
    # the hash of the row deals copies of one text out
    others = [c for c in docs.columns if docs.schema[c].dataType.simpleString() in ("bigint", "int", "string") and c != text]
    keyed = keyed.withColumn(names[2], F.xxhash64(F.lit(2), *others)).drop(*new)
    ids = _encode_chunks(keyed.select(*(F.col(n).alias(f"__k{i + 1}") for i, n in enumerate(names)), F.col(text).alias("text")), vocabulary, chunk, overlap)
    ids = ids.select(*(F.col(f"__k{i + 1}").alias(n) for i, n in enumerate(names)), "token_ids")
    kept = [c for c in docs.columns if c not in new]
    long = keyed.join(ids, names).select(*kept, "token_ids", (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"))
    return short.unionByName(long)


_KEY = "__k1 long, __k2 long, __k3 long"


def _encode_chunks(keyed: DataFrame, vocabulary, chunk: int, overlap: int) -> DataFrame:
    """Long texts (__k1, __k2, __k3, text) to their keys, once each, with token_ids."""
    spark, keys = keyed.sparkSession, ["__k1", "__k2", "__k3"]

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                body, own = row.pop("text"), list(row.values())
                starts = range(0, len(body), chunk)
                n = len(starts)
                yield pa.RecordBatch.from_arrays([*(pa.array([k] * n, pa.int64()) for k in own), pa.array(range(n), pa.int32()), pa.array([n] * n, pa.int32()), pa.array([body[s : s + chunk + overlap] for s in starts], pa.string())], names=[*keys, "part", "parts", "text"])

    def find_boundaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(vocabulary)
        for whole in batches:
            for batch in slices(whole):
                head, tail = [], []
                for part, parts, body in zip(*(batch.column(c).to_pylist() for c in ("part", "parts", "text")), strict=True):
                    at = encoder.boundaries(body)
                    at = at if part == parts - 1 else at[:-_UNSURE]
                    head.append(at[at < overlap].tolist())
                    tail.append((at[at >= chunk] - chunk).tolist())
                rows = batch.drop_columns(["text"])
                yield appended(rows, ["head", "tail"], [pa.array(head, pa.list_(pa.int32())), pa.array(tail, pa.list_(pa.int32()))])

    def encode_between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(vocabulary)
        for whole in batches:
            for batch in slices(whole):
                ids = [encoder.encode(body[a:b]) for body, a, b in zip(*(batch.column(c).to_pylist() for c in ("text", "begin", "end")), strict=True)]
                yield appended(batch.drop_columns(["text", "begin", "end"]), ["ids"], [pa.array(ids, pa.binary())])

    def encode_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(vocabulary)
        for whole in batches:
            for batch in slices(whole):
                ids = [encoder.encode(body) for body in batch.column("text").to_pylist()]
                yield appended(batch.drop_columns(["text"]), ["token_ids"], [pa.array(ids, pa.binary())])

    n = partitions(spark, 1)
    rows = keyed.mapInArrow(cut_up, f"{_KEY}, part int, parts int, text string").repartition(n, *keys, "part")
    bounds = rows.mapInArrow(find_boundaries, f"{_KEY}, part int, parts int, head array<int>, tail array<int>")
    # what a chunk's end and its successor's beginning agree on; rows of one text with equal keys are copies
    ends = bounds.select(*keys, (F.col("part") + 1).alias("part"), "tail").distinct()
    starts = bounds.select(*keys, "part", "parts", "head").distinct()
    seams = starts.join(ends, [*keys, "part"], "left").select(*keys, "part", "parts", F.when(F.col("part") == 0, 0).otherwise(F.array_min(F.array_intersect("head", "tail"))).alias("begin"))
    place = F.struct("part", "begin")
    texts = cut(seams.groupBy(*keys).agg(F.array_sort(F.collect_list(place)).alias("seams"), F.max("parts").alias("parts"), F.count("begin").alias("found")))
    agreed = texts.where("found = parts").select(*keys, F.posexplode("seams").alias("part", "s"), "seams", "parts")
    spans = agreed.select(*keys, "part", F.col("s.begin").alias("begin"), F.coalesce(F.get("seams", F.col("part") + 1)["begin"] + chunk, F.lit(2**31 - 1)).alias("end"))
    encoded = rows.drop("parts").join(spans.repartition(n, *keys, "part"), [*keys, "part"]).mapInArrow(encode_between, f"{_KEY}, part int, ids binary")
    parts = F.array_sort(F.collect_set(F.struct("part", "ids")))
    joined = encoded.groupBy(*keys).agg(parts.alias("p")).select(*keys, F.aggregate("p", F.lit(b""), lambda s, x: F.concat(s, x["ids"])).alias("token_ids"))
    apart = keyed.join(texts.where("found < parts").select(*keys), keys, "left_semi").mapInArrow(encode_whole, f"{_KEY}, token_ids binary").distinct()
    return joined.unionByName(apart)


def decode(encoded: DataFrame, ids: str = "token_ids", path: str | None = None) -> DataFrame:
    """Adds decoded (binary) to rows with token ids; null ids decode to no bytes."""
    vocabulary = broadcast_vocabulary(encoded.sparkSession, path)

    def decode_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(vocabulary.value)
        for whole in batches:
            for batch in slices(whole):
                yield appended(batch, ["decoded"], [pa.array([decoder.decode(x) if x else b"" for x in batch.column(ids).to_pylist()], pa.binary())])

    return encoded.mapInArrow(decode_rows, with_columns(encoded, {"decoded": "binary"}))
