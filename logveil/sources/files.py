"""Readers: text of any charset, gzip by content, lines, JSON, mappings and labelled corpora."""

from __future__ import annotations

import gzip
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logveil.operators.records import is_damaged, normalized_newlines, numbered_lines
from logveil.sources.shared import few, written

# ---- fixed values: charsets in the order in which they are tried ----
SINGLE_BYTE = ["cp1251", "cp1252", "latin-1"]
# ---- end of fixed values ----
_SAMPLE = 65_536
MAPPING = "schema_version int, algorithm string, algorithm_version int, salt string, mapping map<string,string>"
CORPUS = "id string, input string, must_keep array<string>, must_not_contain array<string>"


def relative(path: Column, folder: str) -> Column:
    """A file's path below a folder."""
    plain = folder.rstrip("/").removeprefix("file://").removeprefix("file:")
    return F.regexp_replace(path, f"^.*?\\Q{plain}\\E/", "")


def _quality(text: str) -> float:
    head = text[:20_000]
    bad = sum(c == "�" or (c < " " and c not in "\t\n\r") for c in head)
    return 1 - bad / len(head) if head else 1.0


def _decoded(raw: bytes) -> tuple[str, str]:
    """Text and charset: UTF-8 if it is valid, UTF-16 if it says so, else the best single-byte charset."""
    if raw[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return raw.decode("utf-16", "replace"), "utf-16"
    try:
        return raw.decode("utf-8-sig"), "utf-8"
    except UnicodeDecodeError:
        pass
    best = max(SINGLE_BYTE, key=lambda c: (_quality(raw.decode(c, "replace")), -SINGLE_BYTE.index(c)))
    return raw.decode(best, "replace"), best


def whole_files(spark: SparkSession, paths: str | list[str], pattern: str | None = None, most_bytes: int | None = None, missing_ok: bool = True, where: Column | None = None) -> DataFrame:
    """One row per file: path, size_bytes, charset, gzipped, oversized, damaged and text (newlines as line feeds).

    `where` is a condition on length; files that it leaves out are not read.

    Empty files give no row (Spark's file sources pass over them).  Gzip is known by its first bytes.  Valid UTF-8 stays in the JVM; only other files go through Python.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreMissingFiles", missing_ok)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    loaded = reader.load(paths) if where is None else reader.load(paths).where(where)
    files = loaded.withColumn("gzipped", F.substring("content", 1, 2) == F.lit(b"\x1f\x8b"))
    files = files.select("path", F.col("length").alias("size_bytes"), "content", "gzipped", F.lit(False if most_bytes is None else None).alias("__o"))
    files = files.withColumn("oversized", F.lit(False) if most_bytes is None else F.col("size_bytes") > most_bytes).drop("__o")
    plain = ~F.col("gzipped") & F.is_valid_utf8(F.col("content").cast("string")) & ~F.substring("content", 1, 3).isin(b"\xef\xbb\xbf")
    easy = files.where(plain).select("path", "size_bytes", "gzipped", "oversized", F.lit("utf-8").alias("charset"), F.decode("content", "UTF-8").alias("text"))

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            raw = [gzip.decompress(c) if z else c for c, z in zip(rows["content"], rows["gzipped"], strict=True)]
            got = [_decoded(bytes(r)) for r in raw]
            yield rows.drop(columns="content").assign(charset=[g[1] for g in got], text=[g[0] for g in got])

    hard = files.where(~plain).mapInPandas(decode, "path string, size_bytes long, gzipped boolean, oversized boolean, charset string, text string")
    every = easy.unionByName(hard)
    return every.withColumn("damaged", is_damaged(F.col("text"))).withColumn("text", normalized_newlines(F.col("text")))


def detect_charset(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, charset) from the first 64 KiB of each file; a cut last character does not count."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
    sample = files.select("path", F.substring("content", 1, _SAMPLE).alias("content"))

    def guess(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            names = []
            for raw in map(bytes, rows["content"]):
                for cut in range(4):
                    name = _decoded(raw[: len(raw) - cut])[1]
                    if name == "utf-8" or len(raw) < _SAMPLE:
                        break
                names.append(name)
            yield pd.DataFrame({"path": rows["path"], "charset": names})

    return sample.mapInPandas(guess, "path string, charset string")


def lines(spark: SparkSession, paths: str | list[str], pattern: str | None = None) -> DataFrame:
    """(path, line_no, line) of text files, numbered from 1; charsets and gzip as in whole_files.

    A line feed at the end begins no further line.  A file is read by one task; for large files see numbered_text_lines.
    """
    files = whole_files(spark, paths, pattern).select("path", "text")
    return numbered_lines(files.withColumn("text", F.when(F.col("text").endswith("\n"), F.expr("left(text, length(text) - 1)")).otherwise(F.col("text"))))


def text_lines(spark: SparkSession, paths: str | list[str], pattern: str | None = None) -> DataFrame:
    """(path, line) of large UTF-8 files, read in splits; for jobs that need no line numbers."""
    reader = spark.read.option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.text(paths).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"))


def numbered_text_lines(spark: SparkSession, paths: str | list[str], pattern: str | None = None) -> DataFrame:
    """(path, line_no, line) of large UTF-8 files, read in splits by several tasks and numbered from 1.

    A first pass counts the lines of each split; the sums over a file's earlier splits are what the second
    pass adds to a line's place in its own.  Both passes read the same splits, and only (path, split, two
    numbers) moves between them.
    """
    reader = spark.read.option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    # ids of a task's rows follow one another, and a split's rows stand together and in order
    name = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    rows = reader.text(paths).select(name.alias("path"), F.col("_metadata.file_block_start").alias("__split"), F.monotonically_increasing_id().alias("__id"), F.col("value").alias("line"))
    counted = written(rows.groupBy("path", "__split").agg(F.min("__id").alias("__first"), F.count(F.lit(1)).alias("__n")), "splits")
    before = F.sum("__n").over(Window.partitionBy("path").orderBy("__split").rowsBetween(Window.unboundedPreceding, -1))
    splits = counted.withColumn("__before", F.coalesce(before, F.lit(0))).drop("__n")
    return rows.join(few(splits), ["path", "__split"]).select("path", (F.col("__before") + F.col("__id") - F.col("__first") + 1).alias("line_no"), "line")


def large_files(spark: SparkSession, paths: str | list[str], pattern: str | None, least: int) -> list[str]:
    """Paths of the files of more than `least` bytes."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return sorted(r["path"] for r in reader.load(paths).where(F.col("length") > least).select("path").collect())


#: Names of files that a reader of lines unpacks.
PACKED = (".gz", ".bz2", ".lz4", ".snappy", ".deflate", ".zst", ".zstd")


def escaped(path: str) -> str:
    """A path as a pattern of itself."""
    return re.sub(r"([\\*?{}\[\]])", r"\\\1", path)


def load_mapping(spark: SparkSession, path: str) -> DataFrame:
    """(original, pseudonym) of an exported mapping document; one of another schema version is an error."""
    doc = spark.read.option("multiLine", True).schema(MAPPING).json(path)
    checked = F.when(F.col("schema_version") == 1, F.col("mapping")).otherwise(F.raise_error(F.lit("unknown schema_version")))
    return doc.select(F.explode(checked).alias("original", "pseudonym"))


def load_corpus(spark: SparkSession, path: str) -> DataFrame:
    """A labelled corpus in JSON Lines."""
    return spark.read.schema(CORPUS).json(path)


def with_shape(df: DataFrame, column: str = "text") -> DataFrame:
    """Adds doc_kind: json, ndjson, text or empty."""
    from logveil.operators.records import doc_kind

    return df.withColumn("doc_kind", doc_kind(F.col(column)))
