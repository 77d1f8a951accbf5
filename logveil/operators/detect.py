"""Findings: where sensitive values stand in raw text, and what is left in masked text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logveil.functions import checks
from logveil.functions.lists import FAMILIES, RESIDUAL_PATH_WORDS, RISK, RISK_OTHER, STRUCTURAL
from logveil.functions.regex import extract_all, gaps, starts
from logveil.plans.options import Options
from logveil.plans.rules import RESIDUAL, Rule, may_hold, pseudonyms, residual_pan, rules

FINDING = "struct<tag:string,value:string,start:int,end:int>"


def rule_findings(text: Column, rule: Rule, options: Options, masked: bool = False, places: bool = True) -> Column:
    """Matches of one rule that pass its check, as an array of (tag, value, start, end); of masked text, those outside pseudonyms.

    Without places, which cost most in long texts, each value is told once and start is 0, but for the rule whose check needs it.
    """
    hidden = pseudonyms(options) if masked else ""
    pattern = f"(?U){hidden}|{rule.pattern}" if masked else rule.pattern
    whole = extract_all(text, pattern)
    if places or rule.tag == "HASH":
        rows = F.arrays_zip(whole.alias("v"), starts(gaps(text, pattern), whole).alias("at"))
    else:
        rows = F.transform(F.array_distinct(whole), lambda v: F.struct(v.alias("v"), F.lit(0).alias("at")))
    found = F.transform(rows, lambda r: F.struct(F.lit(rule.tag).alias("tag"), r["v"].alias("value"), r["at"].cast("int").alias("start"), (r["at"] + F.length(r["v"])).cast("int").alias("end")))
    good = lambda f: ~checks.is_allowed(f["value"], options.allowlist) & (F.lit(True) if rule.check is None or rule.tag == "IP_NET" else rule.check(f["value"], text, f["start"], f["end"]))
    if masked:
        found = F.filter(found, lambda f: ~f["value"].rlike(rf"\A{hidden}\z"))
    return F.when(rule.may_match(text), F.filter(found, good)).otherwise(F.array().cast(f"array<{FINDING}>"))


def family_of(tag: Column) -> Column:
    pairs = [F.lit(x) for name, tags in FAMILIES.items() for t in tags for x in (t, name)]
    return F.when(tag.startswith("CUSTOM:"), "CUSTOM").otherwise(F.coalesce(F.create_map(*pairs)[tag], tag))


def findings(df: DataFrame, options: Options, column: str = "text", tags: list[str] | None = None, non_overlapping: bool = False) -> DataFrame:
    """One row per finding: the table's columns, tag, family, value, start, end and line (from 1).

    All rules see the raw text, so findings of several tags can overlap; with non_overlapping, a
    finding gives way to an earlier rule's.
    """
    chosen = [r for r in rules(options) if tags is None or r.tag in tags]
    arrays = [rule_findings(F.col(column), r, options) for r in chosen]
    every = F.concat(*arrays) if arrays else F.array().cast(f"array<{FINDING}>")
    if non_overlapping:
        apart = lambda x, f: (x["end"] <= f["start"]) | (f["end"] <= x["start"])
        every = F.aggregate(every, F.array().cast(f"array<{FINDING}>"), lambda kept, f: F.when(F.forall(kept, lambda x: apart(x, f)), F.concat(kept, F.array(f))).otherwise(kept))
    rows = df.withColumn("__f", F.explode(every))
    line = F.length(F.substring(F.col(column), F.lit(1), F.col("__f.start"))) - F.length(F.replace(F.substring(F.col(column), F.lit(1), F.col("__f.start")), F.lit("\n"), F.lit(""))) + 1
    return rows.select(*df.columns, "__f.tag", family_of(F.col("__f.tag")).alias("family"), "__f.value", "__f.start", "__f.end", line.cast("int").alias("line"))


def with_snippet(found: DataFrame, column: str = "text", radius: int = 40) -> DataFrame:
    """Adds what stands around each finding, on one line, with dots where the text goes on."""
    low = F.greatest(F.col("start") - radius, F.lit(0))
    high = F.least(F.col("end") + radius, F.length(column))
    body = F.translate(F.substring(F.col(column), low + 1, high - low), "\r\n", "  ")
    return found.withColumn("snippet", F.concat(F.when(low > 0, "…").otherwise(""), body, F.when(high < F.length(column), "…").otherwise("")))


def without_allowed(found: DataFrame, allowlist: DataFrame, value: str = "value") -> DataFrame:
    """Findings whose value does not stand in an allowlist table (value), blanks and case aside."""
    words = allowlist.select(F.lower(F.trim("value")).alias("__w")).where("__w <> ''").distinct()
    return found.join(words, F.lower(F.trim(found[value])) == words["__w"], "left_anti")


def residual(text: Column, options: Options) -> Column:
    """Leftovers in masked text, each (kind, sample) once, as an array in the order of kinds."""
    kept = lambda v: ~checks.is_allowed(v, options.allowlist) & ~checks.is_pseudonym(v)
    tests = {
        "USER": lambda v: ~F.lower(F.substring_index(v, "\\", 1)).isin(*RESIDUAL_PATH_WORDS),
        "UNP": checks.unp_is_valid,
        "IBAN": checks.iban_is_valid,
        "PAN": checks.pan_is_plausible,
        "PHONE": lambda v: ~checks.is_in_hash(v),
    }
    patterns = RESIDUAL | {"PAN": residual_pan(options.min_digit_run)}

    def of_kind(kind: str, pattern: str) -> Column:
        good = (lambda v: kept(v) & tests[kind](v)) if kind in tests else kept
        # strings are told apart by a hash table, structs by comparing each with all others
        samples = F.array_distinct(extract_all(text, f"(?U){pseudonyms(options)}|{pattern}"))
        found = F.transform(F.filter(samples, good), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("sample")))
        return F.when(may_hold(text, kind, pattern.startswith("(?i)")), found).when(text.isNotNull(), F.array().cast("array<struct<kind:string,sample:string>>"))

    return F.concat(*(of_kind(kind, pattern) for kind, pattern in patterns.items()))


def risk(found: Column) -> Column:
    """0 to 100: the sum of the weights of leftovers."""
    weights = F.create_map(*(F.lit(x) for pair in RISK.items() for x in pair))
    return F.aggregate(found, F.lit(0), lambda s, f: F.least(F.lit(100), s + F.coalesce(weights[f["kind"]], F.lit(RISK_OTHER))))


def issues(text: Column, options: Options) -> Column:
    """Tags that masked text still shows, in order, and RESIDUAL where leftovers were found."""
    out = []
    for rule in rules(options):
        if rule.tag in STRUCTURAL or rule.tag.startswith("CUSTOM:"):
            continue
        left = F.filter(rule_findings(text, rule, options, masked=True, places=False), lambda f: ~f["value"].rlike(r"\[[A-Z][A-Za-z0-9_:]+\]"))
        if rule.tag == "IP_NET":
            continue
        out.append(F.when(F.size(left) > 0, rule.tag))
    own = F.filter(residual(text, options), lambda f: ~(f["sample"].contains("[") & f["sample"].contains("]")))
    kinds = F.array_sort(F.array_distinct(F.transform(own, lambda f: f["kind"])))
    return F.array_compact(F.array(*out, F.when(F.size(own) > 0, F.concat(F.lit("RESIDUAL: "), F.array_join(kinds, ", ")))))


def verify(df: DataFrame, options: Options, column: str = "text") -> DataFrame:
    """Adds issues and safe to rows of masked text."""
    # behind a generator, so that a filter on the verdict does not look for the issues once more
    judged = df.withColumn("issues", F.explode(F.array(issues(F.coalesce(F.col(column), F.lit("")), options))))
    return judged.withColumn("safe", F.size("issues") == 0)
