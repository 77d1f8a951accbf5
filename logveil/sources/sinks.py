"""Writers: masked text beside its input, reports, mappings and audit records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logveil.sources.shared import few, written


def output_name(path: Column) -> Column:
    """A relative path without the suffix .gz."""
    return F.regexp_replace(path, r"\.gz$", "")


#: Lines of a file that one task writes.
PART_LINES = 4 << 20
#: Tasks that write the parts of large files.  Names of parts number tasks by five digits, so beyond 99 999 their order would be lost.
PART_TASKS = 10_000


def write_text_mirror(lines: DataFrame, folder: str, by: str = "path", number: str = "line_no", line: str = "line", part_lines: int = PART_LINES) -> None:
    """One folder per input file (rel_path=...), its lines in order.

    A file of more than `part_lines` lines becomes several parts of about that many, written by several
    tasks: its lines are dealt by ranges of their numbers, and parts are in order by name.  With more parts
    than `PART_TASKS`, a task writes several (about 250 of a file at most, beyond which parts hold more lines).
    """
    named = lines.withColumn("rel_path", output_name(F.col(by)))
    sizes = written(named.groupBy("rel_path").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > part_lines), "sizes")
    large = sizes.agg(F.sum("__n").alias("n")).first()["n"] or 0
    small = named.join(few(sizes.select("rel_path")), "rel_path", "left_anti") if large else named

    def put(rows: DataFrame, mode: str, most: int = 0) -> None:
        ordered = rows.sortWithinPartitions("rel_path", number)
        ordered.select("rel_path", F.col(line).alias("value")).write.option("maxRecordsPerFile", most).partitionBy("rel_path").mode(mode).text(folder)

    put(small.repartition("rel_path"), "overwrite")
    if large:
        ranged = named.join(few(sizes.select("rel_path")), "rel_path", "left_semi")
        parts = -(-large // part_lines)
        # a task's files are numbered by three digits; ranges are of unequal size, so few of them are counted on
        most = max(part_lines, -(-large // (PART_TASKS * 250))) if parts > PART_TASKS else 0
        put(ranged.repartitionByRange(min(parts, PART_TASKS), "rel_path", number), "append", most)


def write_report(report: DataFrame, path: str, form: str = "jsonl") -> None:
    """A report as JSON Lines, as one JSON array or as CSV (maps and structs as JSON, lists joined).

    An array is one row, so it is for reports that fit one.
    """
    if form == "jsonl":
        report.write.mode("overwrite").json(path)
    elif form == "json":
        rows = report.select(F.to_json(F.struct("*")).alias("value"))
        rows.agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list("value")), ","), F.lit("]")).alias("value")).write.mode("overwrite").text(path)
    elif form == "csv":
        report.select(*(_flat(report, c).alias(c) for c in report.columns)).write.mode("overwrite").option("header", True).csv(path)
    else:
        raise ValueError(f"unknown form {form}")


def _flat(df: DataFrame, column: str) -> Column:
    kind = df.schema[column].dataType.simpleString()
    if kind == "array<string>":
        return F.array_join(column, "; ")
    return F.to_json(column) if kind.startswith(("map", "struct", "array")) else F.col(column)


def write_mapping(mapping: DataFrame, path: str) -> None:
    """The dictionary as a Parquet table."""
    mapping.write.mode("overwrite").parquet(path)


def export_mapping(mapping: DataFrame, path: str, salt: str | None = None) -> None:
    """The dictionary as one JSON document of its version; it is one row, so for dictionaries that fit one."""
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct("original", "pseudonym"))))
    doc = mapping.select("original", "pseudonym").dropDuplicates(["original"]).agg(entries.alias("mapping"))
    head = [F.lit(1).alias("schema_version"), F.lit("HMAC-SHA256").alias("algorithm"), F.lit(1).alias("algorithm_version"), F.lit(salt).cast("string").alias("salt")]
    doc.select(F.to_json(F.struct(*head, "mapping")).alias("value")).write.mode("overwrite").text(path)


def export_mapping_csv(mapping: DataFrame, path: str) -> None:
    mapping.select(F.col("original").alias("Original"), F.col("pseudonym").alias("Pseudonym")).write.mode("overwrite").option("header", True).csv(path)


def append_audit(record: DataFrame, path: str) -> None:
    record.write.mode("append").json(path)


def read_back(expected: DataFrame, path: str, form: str = "parquet") -> DataFrame:
    """Rows that a written table lacks or has too many of; empty if it is right."""
    stored = expected.sparkSession.read.format(form).schema(expected.schema).load(path)
    return expected.exceptAll(stored).withColumn("side", F.lit("missing")).unionByName(stored.exceptAll(expected).withColumn("side", F.lit("extra")))
