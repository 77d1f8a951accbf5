"""Chunks of documents, and checkpoints in the shared folder.

A chunk is a bounded number of text bytes dealt out by a hash of the row.  What
documents need to know about the rest of the corpus is asked and answered once
for each distinct key of a chunk, so a key that is very frequent costs one
entry per chunk and not one per occurrence.
"""

from __future__ import annotations

import re
import tempfile
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes of a chunk.
CHUNK_BYTES = 8 << 20
#: Chunks and ranges up to which both have their usual size; entries between them number the square of this.
MOST_PIECES = 4096
#: Texts of an Arrow batch.
BATCH_ROWS = 1000
#: Rows of a few numbers that a broadcast may hold.
FEW = 1 << 20


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses the folder that the cluster names in spark.checkpoint.dir; sets one only where none is named."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        # with a local master, driver and executor are one process
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="logveil-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut by a checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def few(rows: DataFrame) -> DataFrame:
    """Short rows to join with (checkpointed or cheap to count), broadcast if there are `FEW` at most."""
    return F.broadcast(rows) if rows.count() <= FEW else rows


class Extent(NamedTuple):
    rows: int
    bytes: int


def extent(docs: DataFrame, text: str = "text") -> Extent:
    """Rows and text bytes of a table."""
    row = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(text)).alias("b")).first()
    return Extent(row["n"] or 0, row["b"] or 0)


def pieces(total_bytes: int, each: int = CHUNK_BYTES) -> int:
    """Chunks (or ranges) of a corpus.  Beyond `MOST_PIECES` they grow, and their number with the root of the corpus only."""
    wanted = max(1, -(-total_bytes // each))
    return wanted if wanted <= MOST_PIECES else int((wanted * MOST_PIECES) ** 0.5)


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes in order, and whether each occurs twice or more."""
    ordered = np.sort(hashes)
    new = np.ones(len(ordered), dtype=bool)
    new[1:] = ordered[1:] != ordered[:-1]
    at = np.flatnonzero(new)
    return ordered[at], np.diff(np.append(at, len(ordered))) > 1


def bounds(keys: np.ndarray, bits: int) -> np.ndarray:
    """Where each of 2 ** bits ranges of hashes begins and ends in ordered keys."""
    edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits) if bits else np.zeros(0, np.uint64)
    return np.concatenate(([0], np.searchsorted(keys, edges), [len(keys)]))


def small_batches(spark: SparkSession) -> None:
    """Batches of at most `BATCH_ROWS` texts between the JVM and Python, whose buffers would else take most of an executor's memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def chunk_of(*columns: str, chunks: int) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(chunks)).cast("int")


def partitions(spark: SparkSession, wanted: int) -> int:
    """Shuffle partitions for so many chunks: at least what the session asks for."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), wanted)
