"""Tables and folders in the shared checkpoint folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Short rows that a broadcast may hold.
FEW = 1 << 18


def checkpoint_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared checkpoint folder; one machine gets a folder of its own where none is named."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="logveil-checkpoint-"))
    return f"{context.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written to the shared folder and read again, so that a lost executor costs no work done before."""
    folder = checkpoint_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """The same rows dealt over all tasks by the hash of some columns (none: in turn), for costly work on tables of few row groups or files."""
    parts = max(4 * df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(parts, *by)


def few(rows: DataFrame) -> DataFrame:
    """Short rows to join with (written, or cheap to count), broadcast if there are `FEW` at most."""
    return F.broadcast(rows) if rows.count() <= FEW else rows
