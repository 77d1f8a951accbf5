"""The tag of a raw value by its format."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from logveil.functions.lists import CLASS_ORDER
from logveil.functions.regex import bind, full_match
from logveil.plans.options import Options
from logveil.plans.rules import rules


def classified(value: Column, options: Options, default: Column | str = "VALUE") -> Column:
    """The first format that a value matches in full and whose check it passes, else `default`.

    Blanks and quotes around the value do not count.
    """
    by_tag = {r.tag: r for r in rules(replace(options, hash_requires_context=False, custom_rules=()))}
    default = F.lit(default) if isinstance(default, str) else default

    def first(bare: Column) -> Column:
        # no format is a short word of letters, digits and underscores
        out: Column | None = F.when(bare.rlike(r"\A[A-Za-z0-9_]{0,8}\z"), F.lit(None).cast("string"))
        for tag in CLASS_ORDER:
            match, check = full_match(bare, by_tag[tag].pattern), by_tag[tag].check
            if check is not None and tag not in ("SID", "UUID", "IP_NET"):
                match = match & check(bare, bare, F.lit(0), F.length(bare))
            out = F.when(match, tag) if out is None else out.when(match, tag)
        return out

    return F.coalesce(bind(F.btrim(F.trim(value), F.lit("\"'")), first), default)


def pseudonym_type(pseudonym: Column) -> Column:
    """The tag within a pseudonym; null for other strings."""
    tag = F.regexp_extract(pseudonym, r"^\[([A-Z][A-Z0-9_:]*?)_[0-9a-f]+(?:_\d+)?\]$", 1)
    return F.when(tag != "", tag)
