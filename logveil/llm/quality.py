"""Quality rules: a threshold table compiled into one Spark projection.

The measures are Column expressions (no user functions, no shuffle) and every
rule of the table becomes one comparison of the projection, so a rule is added
by a table row.  A null text has the measures of an empty one.  Rows are judged
one by one: repeated rows get equal verdicts and an empty table gives an empty
result.  Extra columns are carried, and give way where they are named measures,
failed or kept.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logveil.llm.arrowcols import fresh_name

_BLANKS = " \t\n\x0b\x0c\r"
_SPACE = r"[\x20\x09-\x0D]+"
_SYMBOLS = "#*$%&|<>"

#: Frequent function words of the languages in the corpus.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "for", "with", "as",
    "der", "die", "das", "und", "den", "von", "zu", "mit", "ist", "ein",
    "de", "la", "le", "et", "les", "des", "un", "une", "que", "dans",
    "el", "los", "en", "y", "se", "con", "por", "su", "para", "del",
)


class Rule(NamedTuple):
    """A document fails if its measure is below `least` or above `most`."""

    name: str
    measure: str
    least: float | None = None
    most: float | None = None


#: Thresholds; the first two are the base rules.
RULES = (
    Rule("few_words", "n_words", least=50),
    Rule("repeated_words", "repeat_ratio", most=0.5),
    Rule("many_words", "n_words", most=1_000_000),
    Rule("word_length", "mean_word_chars", least=2, most=15),
    Rule("symbols", "symbol_ratio", most=0.5),
    Rule("stop_words", "stop_word_ratio", least=0.01),
    Rule("capitals", "capital_ratio", most=0.6),
    Rule("repeated_lines", "dup_line_ratio", most=0.5),
)
BASE_RULES = ("few_words", "repeated_words")


def _length_without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def split_words(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text, as an array."""
    return F.filter(F.split(text, _SPACE), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """Words inside a window of three words that the array holds twice or more.

    The windows are sorted together with their places; equal neighbours mark the
    places of repeated windows, and each place counts the words up to the next.
    Arrays whose windows are all distinct are not sorted.
    """
    n = F.size(words)
    grams = F.zip_with(
        F.zip_with(F.slice(words, 1, n - 2), F.slice(words, 2, n - 2), lambda a, b: F.concat_ws(" ", a, b)),
        F.slice(words, 3, n - 2),
        lambda a, b: F.concat_ws(" ", a, b),
    )
    placed = F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

    def places(rows: Column) -> Column:
        equal = lambda a, b: F.coalesce(a["g"] == b["g"], F.lit(False))
        marked = F.transform(rows, lambda r, k: F.when(equal(r, F.get(rows, k - 1)) | equal(r, F.get(rows, k + 1)), r["i"]))
        return F.array_sort(F.array_compact(marked))

    def total(at: Column) -> Column:
        gaps = F.zip_with(F.slice(at, 2, F.size(at)), at, lambda b, a: F.coalesce(F.least(b - a, F.lit(3)), F.lit(3)))
        return F.aggregate(gaps, F.lit(0), lambda s, x: s + x)

    # A one-element transform binds an array to a name, so that it is computed once.
    bind = lambda value, f: F.transform(F.array(value), f)[0]
    counted = bind(grams, lambda g: F.when(F.size(F.array_distinct(g)) < F.size(g), bind(placed, lambda r: bind(places(r), total))).otherwise(0))
    return F.when(n < 4, 0).otherwise(counted)


def with_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds a struct column `measures` to the table."""
    body = F.coalesce(F.col(text), F.lit(""))
    w_name, l_name, c_name = (fresh_name(docs.columns, n) for n in ("_words", "_lines", "_counts"))
    marked = docs.withColumn(w_name, split_words(body)).withColumn(l_name, F.filter(F.split(body, "\n"), lambda x: _length_without(x, _BLANKS) > 0))
    words, lines = F.col(w_name), F.col(l_name)
    n, chars = F.size(words), _length_without(body, _BLANKS)
    capitals = F.length(body) - F.length(F.regexp_replace(body, r"\p{Lu}", ""))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    stops = F.size(F.filter(words, lambda w: F.lower(F.translate(w, ".,;:!?|*$%&#", "")).isin(*STOP_WORDS)))
    counts = F.struct(
        n.cast("long").alias("n_words"),
        chars.cast("long").alias("word_chars"),
        (F.length(body) - _length_without(body, _SYMBOLS)).cast("long").alias("n_symbols"),
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        repeated_words(words).cast("long").alias("n_repeat_words"),
        stops.cast("long").alias("n_stop_words"),
        capitals.cast("long").alias("n_capitals"),
    )
    c = F.col(c_name)
    measures = F.struct(
        f"{c_name}.*",
        ratio(c["word_chars"], c["n_words"]).alias("mean_word_chars"),
        ratio(c["n_symbols"], c["n_words"]).alias("symbol_ratio"),
        ratio(c["n_repeat_words"], c["n_words"]).alias("repeat_ratio"),
        ratio(c["n_stop_words"], c["n_words"]).alias("stop_word_ratio"),
        ratio(c["n_capitals"], c["word_chars"]).alias("capital_ratio"),
        ratio(c["n_dup_lines"], c["n_lines"]).alias("dup_line_ratio"),
    )
    return marked.withColumn(c_name, counts).withColumn("measures", measures).drop(w_name, l_name, c_name)


def failed_rules(rules: tuple[Rule, ...] = RULES) -> Column:
    """Names of the rules that a row's `measures` break."""
    tests = []
    for rule in rules:
        value, low, high = F.col(f"measures.{rule.measure}"), F.lit(False), F.lit(False)
        if rule.least is not None:
            low = value < rule.least
        if rule.most is not None:
            high = value > rule.most
        tests.append(F.when(low | high, F.lit(rule.name)))
    return F.array_compact(F.array(*tests))


def judge(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds `measures`, `failed` (names of broken rules) and `kept` to the table."""
    return with_measures(docs, text).withColumn("failed", failed_rules(rules)).withColumn("kept", F.size("failed") == 0)
