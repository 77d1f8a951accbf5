"""Counts, scan and quality reports, the gate and the score of a labelled corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logveil.functions.regex import extract_all, gaps, starts
from logveil.operators.detect import findings, issues, residual, risk, rule_findings, verify
from logveil.operators.jsondocs import mask_any
from logveil.operators.mapping import replacements
from logveil.operators.mask import mask_text
from logveil.plans.options import Options
from logveil.plans.rules import pseudonyms, rules


def count_by(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows by tag, family or whatever the columns name."""
    return rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("count"))


def totals(rows: DataFrame, approximate: bool = False) -> DataFrame:
    """One row: replacement_occurrences and unique_values (by tag and normalized value)."""
    value = F.struct("tag", "normalized")
    distinct = F.approx_count_distinct(F.xxhash64("tag", "normalized")) if approximate else F.count_distinct(value)
    return rows.agg(F.count(F.lit(1)).alias("replacement_occurrences"), distinct.alias("unique_values"))


def counts_as_map(rows: DataFrame, by: str, key: str = "tag") -> DataFrame:
    """(by, stats_by_type): a map of counts for each value of `by`."""
    counted = count_by(rows, by, key)
    return counted.groupBy(by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key), F.col("count"))))).alias("stats_by_type"))


def _stats(found: Column) -> Column:
    """A map of counts by tag from a replacements column, within the row."""
    kinds = F.array_sort(F.array_distinct(F.transform(found, lambda r: r["tag"])))
    return F.map_from_arrays(kinds, F.transform(kinds, lambda k: F.size(F.filter(found, lambda r: r["tag"] == k)).cast("long")))


def results(df: DataFrame, options: Options, column: str = "text") -> DataFrame:
    """Masked text with its stats, mapping, issues and safe as columns beside the table's own."""
    masked = mask_text(df, options, column, replacements="__found")
    pairs = F.array_distinct(F.transform(F.filter("__found", lambda r: r["reversible"]), lambda r: F.struct(r["original"], r["pseudonym"])))
    last = F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda m, p: F.when(F.map_contains_key(m, p["original"]), m).otherwise(F.map_concat(m, F.map_from_entries(F.array(p)))))
    return verify(masked.withColumn("stats", _stats(F.col("__found"))).withColumn("mapping", last), options, column).drop("__found")


def scan_lines(lines: DataFrame, options: Options, line: str = "line") -> DataFrame:
    """Per line: replacements, unique values, counts by tag, issues of the masked line, and the spans of pseudonyms in it.  No writer."""
    masked = mask_text(lines, options, line, out="masked", replacements="found")
    unique = F.size(F.array_distinct(F.transform("found", lambda r: F.struct(r["tag"], r["normalized"]))))
    out = masked.withColumn("replacements", F.size("found")).withColumn("unique_values", unique).withColumn("stats_by_type", _stats(F.col("found"))).withColumn("changed", ~F.col(line).eqNullSafe(F.col("masked"))).withColumn("spans", pseudonym_spans(F.col("masked"), options))
    return verify(out, options, "masked")


def pseudonym_spans(text: Column, options: Options) -> Column:
    """Where pseudonyms stand in masked text, as an array of (start, end)."""
    pattern = pseudonyms(options)
    found = extract_all(text, pattern)
    places = F.arrays_zip(starts(gaps(text, pattern), found).alias("at"), found.alias("v"))
    spans = F.transform(places, lambda p: F.struct(p["at"].cast("int").alias("start"), (p["at"] + F.length(p["v"])).cast("int").alias("end")))
    return F.when(text.contains("["), spans).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


def scan_files(lines: DataFrame, options: Options, by: str = "path", line: str = "line") -> DataFrame:
    """Per file: size, lines, changed lines, replacements, unique values, counts by tag, issues and safe."""
    rows = scan_lines(lines, options, line).withColumn("size_bytes", F.octet_length(line) + 1).withColumn("n_lines", F.lit(1))
    return summed_up(rows, by)


def summed_up(rows: DataFrame, by: str = "path") -> DataFrame:
    """A row per file from rows with size_bytes, n_lines, changed, found and issues; a document that changed counts with its lines."""
    base = rows.groupBy(by).agg(
        F.sum("size_bytes").cast("long").alias("size_bytes"),
        F.sum("n_lines").cast("long").alias("line_count"),
        F.sum(F.size("found")).cast("long").alias("replacements"),
        F.sum(F.when(F.col("changed"), F.col("n_lines")).otherwise(0)).cast("long").alias("changed_lines"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("issues")))).alias("issues"),
    )
    found = rows.select(by, F.explode("found").alias("r")).select(by, "r.tag", "r.normalized")
    unique = found.distinct().groupBy(by).agg(F.count(F.lit(1)).alias("unique_values"))
    joined = base.join(unique, by, "left").join(counts_as_map(found, by), by, "left")
    return joined.select(by, "size_bytes", "line_count", "changed_lines", "replacements", F.coalesce("unique_values", F.lit(0)).alias("unique_values"), "stats_by_type", "issues", (F.size("issues") == 0).alias("safe"))


def quality(df: DataFrame, options: Options, column: str = "text") -> DataFrame:
    """Adds a struct `quality`: safe, issues, found, total_found, by_type, residual, residual_risk."""
    body = F.coalesce(F.col(column), F.lit(""))
    found = F.concat(*(rule_findings(body, r, options) for r in rules(options)))
    kinds = F.array_sort(F.array_distinct(F.transform("__found", lambda f: f["tag"])))
    by_type = F.map_from_arrays(kinds, F.transform(kinds, lambda k: F.size(F.filter("__found", lambda f: f["tag"] == k))))
    rows = df.withColumn("__found", found).withColumn("__issues", issues(body, options)).withColumn("__left", residual(body, options))
    report = F.struct((F.size("__issues") == 0).alias("safe"), F.col("__issues").alias("issues"), F.col("__found").alias("found"), F.size("__found").alias("total_found"), by_type.alias("by_type"), F.col("__left").alias("residual"), risk(F.col("__left")).alias("residual_risk"))
    return rows.withColumn("quality", report).drop("__found", "__issues", "__left")


def gate(masked: DataFrame, options: Options, column: str = "text") -> tuple[DataFrame, DataFrame]:
    """Rows of masked text that are safe to hand on, and those to hold back."""
    judged = verify(masked, options, column)
    return judged.where("safe"), judged.where("not safe")


def first_findings(found: DataFrame, limit: int = 500) -> DataFrame:
    """The first findings by line, place, tag and value, then by all other columns, with the number of those that are not shown."""
    total = found.agg(F.count(F.lit(1)).alias("__n"))
    first = ["line", "start", "tag", "value"]
    # columns that cannot be ordered (maps) tell no rows apart
    others = sorted(f.name for f in found.schema.fields if f.name not in first and "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant")
    shown = found.orderBy(*first, *others).limit(limit)
    return shown.crossJoin(F.broadcast(total)).withColumn("not_shown", F.greatest(F.col("__n") - limit, F.lit(0))).drop("__n")


def audit(rows: DataFrame, action: str, source: str, org_name: str = "", exit_code: int = 0) -> DataFrame:
    """One row about a run: counts by tag and unique values, never the values."""
    counted = count_by(rows, "tag").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tag", "count")))).alias("stats_by_type"))
    one = totals(rows).crossJoin(F.broadcast(counted))
    return one.select(F.current_timestamp().alias("timestamp"), F.lit(action).alias("action"), F.lit(source).alias("source"), F.lit(org_name).alias("org_name"), "stats_by_type", F.col("unique_values").alias("unique_values_replaced"), F.lit(exit_code).alias("exit_code"))


def score_corpus(corpus: DataFrame, options: Options) -> DataFrame:
    """Labelled rows (id, input, must_keep[], must_not_contain[]) to one row: tp, fn, fp, recall, precision_proxy.

    Inputs of any shape are masked.  A forbidden token that is still there is a miss; a token to keep that is gone is a false positive.
    """
    masked = mask_any(corpus.withColumn("__out", F.col("input")), options, "__out")
    missed = F.size(F.filter("must_not_contain", lambda t: F.col("__out").contains(t)))
    lost = F.size(F.filter("must_keep", lambda t: ~F.col("__out").contains(t)))
    counted = masked.agg(F.sum(F.size("must_not_contain") - missed).alias("tp"), F.sum(missed).alias("fn"), F.sum(lost).alias("fp"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(1.0)
    tp, fn, fp = F.col("tp"), F.col("fn"), F.col("fp")
    return counted.select("tp", "fn", "fp", ratio(tp, tp + fn).alias("recall"), ratio(tp, tp + fp).alias("precision_proxy"))


def findings_report(df: DataFrame, options: Options, column: str = "text") -> tuple[DataFrame, DataFrame]:
    """Counts of findings by tag and by family."""
    found = findings(df, options, column)
    return count_by(found, "tag"), count_by(found, "family")


__all__ = ["audit", "count_by", "counts_as_map", "findings_report", "first_findings", "gate", "quality", "replacements", "results", "scan_files", "scan_lines", "score_corpus", "totals"]
