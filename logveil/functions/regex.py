"""Regular expressions with functions on their matches.

Patterns are Java's; `(?U)` makes \\b, \\w, \\d and \\s and case folding Unicode's.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


#: A noncharacter, which texts do not hold as a rule.
_MARK = "\uffff"


def unicode(pattern: str) -> str:
    return pattern if pattern.startswith("(?U") else f"(?U){pattern}"


def alternatives(words: list[str]) -> str:
    return "|".join(re.escape(w) for w in words)


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Names a value, so that an expression that uses it many times computes it once."""
    return F.transform(F.array(value), lambda x: body(x))[0]


def full_match(value: Column, pattern: str) -> Column:
    return value.rlike(rf"\A(?:{unicode(pattern)})\z")


def extract_all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(unicode(pattern)), F.lit(group))


def gaps(text: Column, pattern: str) -> Column:
    """What stands between the matches: one more than there are matches.

    Replacing keeps its compiled pattern and splitting does not, so matches give way to a character first, where a text has none of it.
    """
    marked = F.split(F.regexp_replace(text, unicode(pattern), _MARK), _MARK, -1)
    return F.when(text.contains(_MARK), F.split(text, unicode(pattern), -1)).otherwise(marked)


def interleave(between: Column, out: Column) -> Column:
    """Gaps and the replacements of their matches, put together.

    Both are computed once; within a function of a gap, all replacements would be for each gap.
    """
    return F.array_join(F.zip_with(between, out, lambda g, o: F.concat(g, F.coalesce(o, F.lit("")))), "")


def sub_with(text: Column, pattern: str, replace: Callable[[Column, Column], Column], group: int = 0) -> Column:
    """Replaces every match by replace(match or group, index); texts without a match are left alone."""
    out = F.transform(extract_all(text, pattern, group), lambda v, i: replace(v, i))
    return F.when(text.rlike(unicode(pattern)), interleave(gaps(text, pattern), out)).otherwise(text)


#: Matches whose places are summed up at a time.
_BLOCK = 512


def starts(between: Column, matches: Column) -> Column:
    """Where each match begins (from 0).

    An array that grows by one is copied each time, so places of many matches are summed up in blocks.
    """
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))
    more = lambda s, at, width: F.struct((s["at"] + width).cast("int").alias("at"), F.concat(s["all"], F.array(at.cast("int"))).alias("all"))
    step = lambda s, p: more(s, s["at"] + F.length(p["g"]), F.length(p["g"]) + F.length(p["m"]))

    def many(pairs: Column) -> Column:
        numbers = F.sequence(F.lit(0), ((F.size(pairs) - 1) / _BLOCK).cast("int"))
        blocks = F.transform(numbers, lambda b: F.aggregate(F.slice(pairs, b * _BLOCK + 1, _BLOCK), empty, step))
        before = lambda x: F.aggregate(x, empty, lambda s, b: more(s, s["at"], b["at"]), lambda s: s["all"])
        return bind(blocks, lambda x: F.flatten(F.zip_with(x, before(x), lambda b, at: F.transform(b["all"], lambda a: a + at))))

    both = F.struct(between.alias("g"), matches.alias("m"))
    pairs = bind(both, lambda x: F.arrays_zip(F.slice(x["g"], 1, F.size(x["m"])).alias("g"), x["m"].alias("m")))
    return bind(pairs, lambda x: F.when(F.size(x) > _BLOCK, many(x)).otherwise(F.aggregate(x, empty, step, lambda s: s["all"])))
