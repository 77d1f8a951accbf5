"""Lines, continued lines, record headers, document shapes and keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# ---- fixed values: headers of records ----
CEF = r"^(.*?)(CEF:\d+(?:\|[^|]*){6})\|(.*)$"
LEEF = r"(?i)^(.*?)(LEEF:\d+(?:\.\d+)?(?:\|[^|]*){4})\|(.*)$"
RFC5424 = r"^(<\d+>\d+\s+\S+\s+)(\S+)(\s+.*)$"
# ---- end of fixed values ----


def normalized_newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def numbered_lines(df: DataFrame, column: str = "text", line: str = "line") -> DataFrame:
    """One row per line, numbered from 1."""
    cut = df.select(*[c for c in df.columns if c != column], F.posexplode(F.split(normalized_newlines(F.col(column)), "\n", -1)).alias("__n", line))
    return cut.withColumn("line_no", (F.col("__n") + 1).cast("long")).drop("__n")


def join_continued(lines: DataFrame, by: str = "path", order: str = "line_no", line: str = "line") -> DataFrame:
    """Joins lines that go on: after a backslash, and before a line that begins with a blank.

    The result has the first line's number.  Empty lines stay.  Lines of one `by` are ordered by a
    window, which sorts with spilling; the parts of one record are put together.
    """
    w = Window.partitionBy(by).orderBy(order)
    before = F.lag(line).over(w)
    slash = F.coalesce(before.endswith("\\"), F.lit(False))
    goes_on = before.isNotNull() & (slash | F.coalesce(F.col(line).rlike(r"^[ \t]"), F.lit(False)))
    marked = lines.withColumn("__slash", slash).withColumn("__new", (~goes_on).cast("int"))
    grouped = marked.withColumn("__g", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("n"), F.col(line).alias("t"), F.col("__slash").alias("s"))))

    def glue(text: Column, part: Column) -> Column:
        left, right = F.regexp_replace(text, r"\\$", ""), F.ltrim(F.regexp_replace(part["t"], r"^\s+", ""))
        space = F.when((left != "") & (right != "") & ~left.rlike(r"\s$"), " ").otherwise("")
        return F.when(part["s"], F.concat(left, space, right)).otherwise(F.concat(text, F.lit(" "), right))

    joined = grouped.groupBy(by, "__g").agg(parts.alias("__p"))
    whole = F.aggregate(F.slice("__p", F.lit(2), F.greatest(F.size("__p") - 1, F.lit(0))), F.get("__p", F.lit(0))["t"], glue)
    return joined.select(by, F.get("__p", F.lit(0))["n"].alias(order), whole.alias(line))


def _header(line: Column, pattern: str, names: tuple[str, str, str]) -> Column:
    core = F.regexp_replace(line, "[\r\n]+$", "")
    return F.when(core.rlike(pattern), F.struct(*(F.regexp_extract(core, pattern, k + 1).alias(n) for k, n in enumerate(names))))


def cef(line: Column) -> Column:
    """struct(prefix, head, ext); null for other lines."""
    return _header(line, CEF, ("prefix", "head", "ext"))


def leef(line: Column) -> Column:
    return _header(line, LEEF, ("prefix", "head", "ext"))


def rfc5424(line: Column) -> Column:
    """struct(pri, host, rest); null for other lines."""
    return _header(line, RFC5424, ("pri", "host", "rest"))


def key_name(key: Column) -> Column:
    """A JSON key without case, `_`, `-` and dots."""
    return F.translate(F.lower(key), "_-.", "")


def path_name(path: Column) -> Column:
    """A JSON path with letters and digits only, in lower case."""
    return F.lower(F.regexp_replace(path, "[^0-9A-Za-z]+", ""))


def doc_kind(text: Column) -> Column:
    """json, ndjson (several lines that each begin like JSON), text or empty."""
    bare = F.trim(F.regexp_replace(text, r"^\s+|\s+$", ""))
    lines = F.filter(F.split(bare, "\n"), lambda x: F.trim(x) != "")
    shaped = bare.rlike(r"(?s)^(?:\{.*\}|\[.*\])$")
    many = (F.size(lines) > 1) & F.forall(lines, lambda x: F.ltrim(x).rlike(r"^[{\[]"))
    # the parser takes the first value of several, so lines that are whole values are looked at first
    whole = F.forall(lines, lambda x: F.trim(x).rlike(r"^(?:\{.*\}|\[.*\])$") & F.try_parse_json(x).isNotNull())
    return F.when(text.isNull() | (bare == ""), "empty").when(many & whole, "ndjson").when(shaped & F.try_parse_json(bare).isNotNull(), "json").when(many, "ndjson").otherwise("text")


def ndjson_lines(df: DataFrame, column: str = "text") -> DataFrame:
    """One row per non-empty line of JSON Lines: line_no, line, kind (json, or text where a line is no document)."""
    rows = numbered_lines(df, column).where(F.trim(F.regexp_replace("line", r"\s+", " ")) != "")
    bare = F.regexp_replace("line", r"^\s+|\s+$", "")
    return rows.withColumn("kind", F.when(bare.rlike(r"(?s)^(?:\{.*\}|\[.*\])$") & F.try_parse_json(bare).isNotNull(), "json").otherwise("text"))


def decode_quality(text: Column) -> Column:
    """1 less the share of U+FFFD and control characters among the first 20 000."""
    head = F.substring(text, 1, 20000)
    bad = F.length(head) - F.length(F.regexp_replace(head, "[�\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]", ""))
    return F.when(F.length(head) > 0, 1 - bad / F.length(head)).otherwise(1.0)


def is_damaged(text: Column) -> Column:
    return text.contains("�")


def count_newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
