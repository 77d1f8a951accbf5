"""Hard negatives of anchors, searched exactly with pruning by lengths and coordinates.

Components become whole numbers floor(256 * x), so scores (inner products) are exact.
An anchor's positives are its best rows of the same label, and the negatives of each
positive are the best rows of other labels within a band below the positive's score.
Both are searches for the highest scores at or above a bound (and at or below the
band's end), and both run the same way:

* Rows are dealt by falling length, so a partition is a run of lengths; a task cuts
  it into buckets of `BUCKET` rows.  A bucket whose longest row cannot reach an
  anchor's bound is skipped.
* A bucket holds a sorted list of each coordinate of its unit vectors.  If q.x must
  reach the bound, the angle of q and x is at most phi, so each coordinate of x lies
  between cos(alpha + phi) and cos(alpha - phi), where alpha is q's angle to that axis.
  The `FOCUS` largest coordinates of an anchor give such ranges in the sorted lists; the
  shortest range's rows that lie in the other ranges too are the candidates, whose
  scores are then computed exactly.  Where even the shortest range holds more than
  `WIDE` of the bucket, lists cannot help: the bucket is scored as a whole.
* Rows are searched in passes, each `GROWTH` times as large as all before it, drawn by
  a hash.  The best scores of the earlier passes are the bounds of the next one, so a
  pass returns a few rows an anchor however many rows it reads.

Anchors are read by tasks in blocks of `BLOCK_BYTES` that the driver broadcasts; all
rows are searched for each block.  Nothing else comes to the driver but the bounds of
a block.

Defined results: rows with a null label, id or vector, with null or non-finite
components, with components beyond `LARGEST` or of another length than the commonest
take no part.  An id names a row: rows that repeat an anchor's id are not its
partners, though they may be partners of others, once for each row; a repeated anchor
is one anchor.  Ties go to the smaller id.  An anchor without positives, or a positive without
negatives in its band, gives no row.  An empty table gives an empty result.  Other
columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logveil.llm.exchange import cut, partitions, small_batches
from logveil.llm.vectors import common_length, matrix, usable

SCALE = 256
#: Components (after scaling) beyond this are no embedding; products of 2^15 of them fit a long.
LARGEST = 1 << 24
POSITIVES, NEGATIVES = 5, 3
#: Hundredths of the positive's score between which a negative lies.
BAND = (50, 95)
#: Bytes of an anchor block's vectors.
BLOCK_BYTES = 32 << 20
#: Bytes of rows that a task holds.
TASK_BYTES = 16 << 20
#: Rows of a bucket, anchors compared with it at a time, and coordinates of an anchor that are looked up.
BUCKET, ABREAST, FOCUS = 2048, 256, 3
#: Share of a bucket beyond which its sorted lists are not used.
WIDE = 0.125
#: Rows of the first pass, and how many times all earlier rows the next pass reads.
FIRST, GROWTH = 4096, 4
_NONE = -(1 << 62)
_ANY_ID = np.iinfo(np.int64).max


class Anchors(NamedTuple):
    """A block of anchors, with the bounds of each one's searches: a column for each search."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    least: np.ndarray  # lowest score that can still enter
    least_id: np.ndarray  # at that score, the largest id that can
    most: np.ndarray  # highest score allowed
    same: bool  # whether partners have the anchor's label, or another one


class Bucket(NamedTuple):
    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    longest: float
    unit: np.ndarray
    order: np.ndarray  # of each coordinate: rows by rising value
    sorted: np.ndarray


def bucket(ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> Bucket:
    """A bucket of rows in the order of their ids, with a sorted list of each coordinate."""
    length = np.sqrt(np.einsum("ij,ij->i", vectors, vectors, dtype=np.float64))
    unit = vectors / np.maximum(length, 1e-300)[:, None]
    order = np.argsort(unit, axis=0, kind="stable")
    return Bucket(ids, labels, vectors, float(length.max(initial=0)), unit, order, np.take_along_axis(unit, order, 0))


def buckets(ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, by_label: bool) -> Iterator[Bucket]:
    """Rows cut by falling length into buckets; with by_label, each of one label."""
    length = np.einsum("ij,ij->i", vectors, vectors, dtype=np.float64)
    for label in np.unique(labels) if by_label else [None]:
        rows = np.flatnonzero(labels == label) if by_label else np.arange(len(ids))
        rows = rows[np.lexsort((ids[rows], -length[rows]))]
        for at in range(0, len(rows), BUCKET):
            part = np.sort(rows[at : at + BUCKET])
            part = part[np.argsort(ids[part], kind="stable")]
            yield bucket(ids[part], labels[part], vectors[part])


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products, exact: in floating point where that cannot round."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64) if most < 1 << 53 else a @ b.T


def ranges(q: np.ndarray, least: np.ndarray, own: Bucket) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each anchor: whether the bucket can reach its bound, its focus coordinates, and where their feasible values begin and end in the lists."""
    length = np.sqrt(np.einsum("ij,ij->i", q, q, dtype=np.float64))
    reach = length * own.longest
    cosine = np.divide(least, reach, out=np.full(len(q), np.inf), where=reach > 0)
    can = (cosine <= 1 + 1e-9) | (least <= 0)
    unit = q / np.maximum(length, 1e-300)[:, None]
    focus = np.argsort(-np.abs(unit), axis=1, kind="stable")[:, :FOCUS]
    phi = np.arccos(np.clip(cosine, -1, 1))[:, None]
    # a bound of 0 or less says nothing about shorter rows of the bucket: their angle may be anything
    phi = np.where((least <= 0)[:, None], np.pi, phi)
    alpha = np.arccos(np.clip(np.take_along_axis(unit, focus, 1), -1, 1))
    low = np.where(alpha + phi >= np.pi, -1.0, np.cos(np.minimum(alpha + phi, np.pi))) - 1e-9
    high = np.where(alpha - phi <= 0, 1.0, np.cos(np.maximum(alpha - phi, 0))) + 1e-9
    begin, end = np.zeros(focus.shape, np.int64), np.zeros(focus.shape, np.int64)
    for c in np.unique(focus):
        at = focus == c
        begin[at] = np.searchsorted(own.sorted[:, c], low[at], "left")
        end[at] = np.searchsorted(own.sorted[:, c], high[at], "right")
    return can, focus, begin, end


def candidates(q: np.ndarray, least: np.ndarray, own: Bucket) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor, row, score) of all rows of a bucket that may reach an anchor's bound."""
    can, focus, begin, end = ranges(q, least, own)
    width = end - begin
    best = width.argmin(axis=1)
    narrow = can & (width.min(axis=1) <= WIDE * len(own.ids))
    found = []
    for i in np.flatnonzero(narrow).tolist():
        j = best[i]
        rows = own.order[begin[i, j] : end[i, j], focus[i, j]]
        for other in range(focus.shape[1]):
            c = focus[i, other]
            if other != j and len(rows) and width[i, other]:
                value = own.unit[rows, c]
                rows = rows[(value >= own.sorted[begin[i, other], c]) & (value <= own.sorted[end[i, other] - 1, c])]
            elif not width[i, other]:
                rows = rows[:0]
        if len(rows):
            found.append((np.full(len(rows), i), rows, scores(q[i : i + 1], own.vectors[rows])[0]))
    if found:
        yield tuple(np.concatenate(x) for x in zip(*found, strict=True))
    whole = np.flatnonzero(can & ~narrow)
    if len(whole):
        all_scores = scores(q[whole], own.vectors)
        at, rows = np.nonzero(all_scores >= least[whole][:, None])
        yield whole[at], rows, all_scores[at, rows]


def search(block: Anchors, own: Bucket, keep: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(anchor, search, id, score) of the best rows of a bucket within each search's bounds, `keep` at most."""
    chosen = np.flatnonzero(block.labels == own.labels[0]) if block.same and len(own.ids) else np.arange(len(block.ids))
    least = block.least.min(axis=1)
    chosen = chosen[least[chosen] <= block.most.max(axis=1)[chosen]]
    for lo in range(0, len(chosen), ABREAST):
        anchors = chosen[lo : lo + ABREAST]
        for at, rows, score in candidates(block.vectors[anchors], least[anchors], own):
            at = anchors[at]
            if block.same:
                other = own.ids[rows] != block.ids[at]
            else:
                other = (own.labels[rows] != block.labels[at]) & (own.ids[rows] != block.ids[at])
            at, rows, score = at[other], rows[other], score[other]
            for j in range(block.least.shape[1]):
                enters = (score > block.least[at, j]) | (score == block.least[at, j]) & (own.ids[rows] <= block.least_id[at, j])
                mine = np.flatnonzero(enters & (score <= block.most[at, j]))
                # rows stand in the order of their ids
                mine = mine[np.lexsort((rows[mine], -score[mine], at[mine]))]
                first = np.flatnonzero(np.append(True, at[mine][1:] != at[mine][:-1])) if len(mine) else np.zeros(0, np.int64)
                place = np.arange(len(mine)) - np.repeat(first, np.diff(np.append(first, len(mine))))
                mine = mine[place < keep]
                if len(mine):
                    yield at[mine], np.full(len(mine), j), own.ids[rows[mine]], score[mine]


_FOUND = "anchor int, search int, partner long, score long"


def _best(found: DataFrame, keep: int) -> DataFrame:
    order = Window.partitionBy("anchor", "search").orderBy(F.desc("score"), "partner")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def _pass(rows: DataFrame, d: int, block: Anchors, keep: int) -> DataFrame:
    """The best partners among some rows."""
    sent = rows.sparkSession.sparkContext.broadcast(tuple(block))

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        anchors = Anchors(*sent.value)
        ids, labels = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in held]) for c in ("vec_id", "label"))
        vectors = np.concatenate([matrix(b.column("x"), d) for b in held])
        for own in buckets(ids, labels, vectors, anchors.same):
            for at, search_no, partner, score in search(anchors, own, keep):
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(search_no.astype(np.int32)), pa.array(partner), pa.array(score)], names=["anchor", "search", "partner", "score"])

    return _best(rows.mapInArrow(within, _FOUND), keep)


def _searched(groups: list[DataFrame], d: int, block: Anchors, keep: int) -> DataFrame:
    """The best partners among all rows, group by group with rising bounds."""
    best = None
    for i, rows in enumerate(groups):
        new = _pass(rows, d, block, keep)
        best = cut(new if best is None else _best(best.drop("rank").unionByName(new.drop("rank")), keep))
        if i + 1 < len(groups):
            last = best.where(F.col("rank") == keep).select("anchor", "search", "score", "partner").toPandas()
            least, least_id = block.least.copy(), block.least_id.copy()
            at = (last["anchor"].to_numpy(), last["search"].to_numpy())
            least[at], least_id[at] = last["score"].to_numpy(), last["partner"].to_numpy()
            block = block._replace(least=least, least_id=least_id)
    return best


def passes(n: int) -> list[float]:
    """Shares of the rows up to which each pass comes."""
    upto, out = FIRST, []
    while upto < n:
        out.append(upto / n)
        upto *= GROWTH
    return [*out, 1.0]


def _groups(rows: DataFrame, n: int, d: int) -> list[DataFrame]:
    """Rows in passes drawn by a hash of the id, each dealt by falling length."""
    spark, low, out = rows.sparkSession, 0.0, []
    draw = F.pmod(F.xxhash64("vec_id", F.lit(11)), F.lit(1 << 40)) / (1 << 40)
    length = F.aggregate("x", F.lit(0.0), lambda a, c: a + c.cast("double") * c)
    for high in passes(n):
        share = n * (high - low)
        parts = max(1, min(partitions(spark, 1), round(share / (FIRST / 4))), round(share * d * 8 / TASK_BYTES))
        part = rows.where((draw >= low) & (draw < high)).repartitionByRange(parts, length.desc(), "vec_id")
        out.append(cut(part))
        low = high
    return out


def mine(df: DataFrame, anchors: Column, vector: str = "embedding", vec_id: str = "vec_id", label: str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES, band: tuple[int, int] = BAND) -> DataFrame:
    """Hard negatives of the rows where `anchors` holds (a condition on the id, here `vec_id`).

    Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score.
    """
    spark = df.sparkSession
    small_batches(spark)
    wanted = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    large = F.exists(F.col(vector).cast("array<double>"), lambda c: F.abs(c * SCALE) >= LARGEST)
    fitting = df.where(usable(vector) & ~large & F.col(vec_id).isNotNull() & F.col(label).isNotNull())
    d = common_length(fitting, vector)
    if d == 0:
        return spark.createDataFrame([], wanted)
    rows = fitting.where(F.size(vector) == d).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.transform(F.col(vector).cast("array<double>"), lambda c: F.floor(c * SCALE)).alias("x"))
    # rows of one id that differ are ordered by what they hold, so that any run numbers anchors alike
    asked = cut(rows.where(anchors).distinct())
    n_anchors = asked.count()
    groups = _groups(rows, rows.count(), d)
    blocks = max(1, -(-n_anchors * d * 8 // BLOCK_BYTES))
    of = F.pmod(F.xxhash64("vec_id", "label", "x"), F.lit(blocks))
    found = [_mine_block(asked.where(of == i), groups, d, positives, negatives, band) for i in range(blocks)] if n_anchors else []
    return reduce(DataFrame.unionByName, [x for x in found if x is not None], spark.createDataFrame([], wanted))


def _mine_block(asked: DataFrame, groups: list[DataFrame], d: int, positives: int, negatives: int, band: tuple[int, int]) -> DataFrame | None:
    spark = asked.sparkSession
    held = asked.toArrow()
    n = held.num_rows
    if not n:
        return None
    ids, labels = held["vec_id"].to_numpy(), held["label"].to_numpy()
    vectors = matrix(held["x"].combine_chunks(), d)
    one = np.ones((n, 1), np.int64)
    top = _searched(groups, d, Anchors(ids, labels, vectors, _NONE * one, _ANY_ID * one, -_NONE * one, True), positives)
    # each positive is a search of its own for negatives
    least, most = np.full((n, positives), -_NONE), np.full((n, positives), _NONE)
    near = top.select("anchor", "rank", "score").toPandas()
    at, p = (near["anchor"].to_numpy(), near["rank"].to_numpy() - 1), near["score"].to_numpy(np.int64)
    least[at], most[at] = -(-band[0] * p // 100), band[1] * p // 100
    hard = _searched(groups, d, Anchors(ids, labels, vectors, least, np.full((n, positives), _ANY_ID), most, False), negatives)
    names = spark.createDataFrame(pa.table({"anchor": pa.array(np.arange(n, dtype=np.int32)), "anchor_id": pa.array(ids)}))
    pairs = top.select("anchor", (F.col("rank") - 1).alias("search"), F.col("partner").alias("positive_id"), F.col("score").alias("positive_score"))
    return (
        hard.select("anchor", "search", F.col("rank").cast("int").alias("rank"), F.col("partner").alias("negative_id"), F.col("score").alias("negative_score"))
        .join(pairs, ["anchor", "search"])
        .join(F.broadcast(names), "anchor")
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )
