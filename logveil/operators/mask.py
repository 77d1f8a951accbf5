"""Masking of free text, lines and columns.

Replacements are rows (tag, original, normalized, pseudonym, reversible): for a
partial mask the hidden middle, for a format mask (which cannot be undone) the
whole value with reversible = false.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logveil.functions import checks
from logveil.functions.hashing import normalized, pseudonym
from logveil.functions.regex import bind, extract_all, gaps, interleave, starts
from logveil.operators.classify import classified
from logveil.operators.joins import lookup
from logveil.plans.options import Options
from logveil.plans.rules import RFC5424_HOST, Rule, pseudonyms, rules
from logveil.sources.shared import written

REPLACEMENT = "struct<tag:string,original:string,normalized:string,pseudonym:string,reversible:boolean>"


def format_mask(value: Column) -> Column:
    """Letters to X and x, digits to 9, the rest kept."""
    lower = F.regexp_replace(value, r"[\p{L}&&[^\p{Lu}]]", "x")
    return F.regexp_replace(F.regexp_replace(lower, r"\p{Lu}", "X"), r"\p{Nd}", "9")


def _split_partial(value: Column, tag: str) -> Column:
    """(head, middle, tail) of a partial mask; the middle is hidden."""
    n = F.length(value)
    if tag == "PHONE":
        wide = F.trim(value).rlike(r"^(?:\+|375|80)")
        keep = F.when(wide, F.least(F.lit(4), F.greatest(F.lit(2), F.floor(n / 5)))).otherwise(F.greatest(F.lit(1), F.least(F.lit(2), F.floor(n / 4))))
    else:
        keep = F.greatest(F.lit(1), F.least(F.lit(2), F.floor(n / 4)))
    keep = F.when(n <= 2, 0).otherwise(keep).cast("int")
    part = lambda head, middle, tail: F.struct(head.alias("head"), middle.alias("middle"), tail.alias("tail"))
    out = part(F.left(value, keep), F.substring(value, keep + 1, n - 2 * keep), F.right(value, keep))
    if tag in ("PAN", "CARD"):
        d = checks.digits(value)
        out = F.when(F.length(d) >= 10, part(F.left(d, F.length(d) - 4), F.lit("").cast("string"), F.lit("")).withField("middle", F.left(d, F.length(d) - 4)).withField("head", F.lit("")).withField("tail", F.right(d, F.lit(4)))).otherwise(out)
    if tag == "IBAN":
        out = F.when(n >= 8, part(F.left(value, F.lit(4)), F.substring(value, F.lit(5), n), F.lit(""))).otherwise(out)
    return out


def masked_value(value: Column, tag: Column | str, options: Options, strategy: str = "full", canonical: str | None = None, allowed: Column | None = None) -> Column:
    """One value to struct(out, replacement); an allowed value stays and has no replacement.

    Besides those of the options, the values of an array `allowed` are, in the form of `allowed_form`.
    """
    none = F.lit(None).cast(REPLACEMENT)

    def made(hidden: Column, tag: Column, out, reversible: bool = True) -> Column:
        """Hides one string; it and its pseudonym are named, so that each is computed once."""

        def rows(x: Column) -> Column:
            row = F.struct(tag.alias("tag"), x["hidden"].alias("original"), normalized(x["hidden"], tag).alias("normalized"), (x["name"] if reversible else F.lit(None).cast("string")).alias("pseudonym"), F.lit(reversible).alias("reversible"))
            return F.struct(out(x["name"]).alias("out"), row.alias("replacement"))

        name = pseudonym(F.lit(canonical) if canonical else hidden, tag, options.key)
        new = bind(F.struct(hidden.alias("hidden"), name.alias("name")), rows)
        if not options.allowlist and allowed is None:
            return new
        stays = checks.is_allowed(hidden, options.allowlist)
        if allowed is not None:
            stays = stays | F.array_contains(allowed, checks.allowed_form(hidden))
        return F.when(stays, F.struct(out(hidden).alias("out"), none.alias("replacement"))).otherwise(new)

    if not isinstance(tag, str):
        return bind(F.struct(value.alias("v"), tag.alias("t")), lambda x: made(x["v"], x["t"], lambda name: name))
    if strategy == "format":
        return made(value, F.lit(tag), lambda _: format_mask(value), reversible=False)
    if strategy == "partial":
        return bind(_split_partial(value, tag), lambda p: made(p["middle"], F.lit(tag), lambda name: F.concat(p["head"], name, p["tail"])))
    return made(value, F.lit(tag), lambda name: name)


def _rule_step(state: Column, rule: Rule, options: Options, allowed: Column | None = None) -> Column:
    """A state (text, found) after one rule.  Pseudonyms match first and stay, so no rule looks into one."""
    text, hidden = state["text"], pseudonyms(options)
    pattern = f"(?U){hidden}|{rule.pattern}"
    whole = extract_all(text, pattern)
    between = gaps(text, pattern)
    fields = [whole.alias("m")]
    if rule.value != (0,):
        fields += [extract_all(text, pattern, k).alias(f"g{k}") for k in sorted({1, *rule.value})]
    if rule.check is not None and rule.tag == "HASH":
        fields.append(starts(between, whole).alias("at"))
    rows = F.arrays_zip(*fields)

    def replaced(row: Column) -> Column:
        if rule.value == (0,):
            return judged(row, row["m"], F.lit(""), F.lit(""))
        groups = [row[f"g{k}"] for k in rule.value]
        if len(groups) == 1:
            return judged(row, groups[0], row["g1"], F.lit(""))
        quote = F.when(groups[0] != "", '"').when(groups[1] != "", "'").otherwise("")
        named = F.struct(F.coalesce(*(F.when(g != "", g) for g in groups), F.lit("")).alias("v"), quote.alias("q"))
        return bind(named, lambda x: judged(row, x["v"], F.concat(row["g1"], x["q"]), x["q"]))

    def judged(row: Column, value: Column, head: Column, tail: Column) -> Column:
        tag: Column | str = rule.forced or ""
        if rule.forced is None:
            default: Column | str = rule.default
            if rule.user_fields:
                name = F.lower(F.regexp_extract(row["g1"], r"^([^=]*)=", 1))
                default = F.when(name.isin(*(f.lower() for f in rule.user_fields)), "USER").otherwise(rule.default)
            tag = classified(value, options, default)
        keep = F.struct(row["m"].alias("out"), F.lit(None).cast(REPLACEMENT).alias("replacement"))
        masked = masked_value(value, tag, options, rule.strategy, rule.canonical, allowed)
        if rule.value != (0,):
            masked = bind(masked, lambda x: F.struct(F.concat(head, x["out"], tail).alias("out"), x["replacement"].alias("replacement")))
        good = (value != "") & ~(row["m"].startswith("[") & row["m"].rlike(rf"\A{hidden}\z"))
        if rule.check is not None:
            at = row["at"] if rule.tag == "HASH" else F.lit(0)
            good = good & rule.check(value, text, at, at + F.length(value))
        if rule.value != (0,) or rule.tag == "CONN_STR":
            good = good & ~checks.holds_pseudonym(value)
        return F.when(good, masked).otherwise(keep)

    def put_together(parts: Column) -> Column:
        rows = F.filter(F.transform(parts, lambda p: p["replacement"]), lambda r: r.isNotNull())
        return F.struct(interleave(between, F.transform(parts, lambda p: p["out"])).alias("text"), F.concat(state["found"], rows).alias("found"))

    return F.when(rule.may_match(text), bind(F.transform(rows, replaced), put_together)).otherwise(state)


_HOST = Rule("RFC5424", RFC5424_HOST, value=(2,))


def mask_steps(options: Options, tags: list[str] | None = None) -> list[Rule]:
    """The rules that masking applies, in order; with tags, only theirs (RFC5424 is the host of a syslog line)."""
    steps = [_HOST] if options.mask_structured_hosts else []
    steps += [r for r in rules(options) if r.tag != "IP_NET"]
    return [r for r in steps if tags is None or r.tag in tags]


def own_name(pseudonym: Column, hash_len: int) -> Column:
    """A pseudonym under a longer hash with this many of its digits."""
    return F.regexp_replace(pseudonym, rf"(_[0-9a-f]{{{hash_len}}})[0-9a-f]*\]$", "$1]")


def start_state(text: Column) -> Column:
    return F.struct(text.alias("text"), F.array().cast(f"array<{REPLACEMENT}>").alias("found"))


def settled(df: DataFrame, column: str) -> DataFrame:
    """The same rows behind a generator, through which no filter moves.

    A filter on the result would else be rewritten in terms of every projection below, and grow with each.
    """
    return df.withColumn(column, F.explode(F.array(column)))


def mask_text(df: DataFrame, options: Options, column: str = "text", out: str | None = None, replacements: str | None = None, tags: list[str] | None = None, allowed: str | None = None) -> DataFrame:
    """Masks a text column; `out` (default: in place) has the masked text, `replacements` what was replaced.

    One projection for each rule and no shuffle.  Null stays null (with no replacements).  `allowed` names a
    column of the values that stay in that row, an array.
    """
    state = df.withColumn("__state", start_state(F.col(column)))
    for rule in mask_steps(options, tags):
        state = state.withColumn("__state", _rule_step(F.col("__state"), rule, options, F.col(allowed) if allowed else None))
    state = settled(state, "__state").withColumn(out or column, F.col("__state.text"))
    if replacements:
        state = state.withColumn(replacements, F.coalesce(F.col("__state.found"), F.array().cast(f"array<{REPLACEMENT}>")))
    return state.drop("__state")


def mask_text_allowing(df: DataFrame, options: Options, allowlist: DataFrame, column: str = "text", out: str | None = None, replacements: str | None = None, tags: list[str] | None = None) -> DataFrame:
    """`mask_text` with a whole table (value) of values that stay, blanks and case aside, besides those of the options.

    The values that a row had replaced are looked up in the table.  Rows without an allowed one are done, as the
    table changes nothing in them; the others are masked again with theirs as allowed, until no more turn up
    (a later rule may take what an earlier one leaves).  A round settles one rule at least, and mostly the second is the last.
    """
    words = allowlist.select(checks.allowed_form(F.col("value")).alias("__word")).where("__word <> ''").distinct().withColumn("__listed", F.lit(True))
    words = written(words, "allowlist")

    def masked(rows: DataFrame) -> DataFrame:
        new = mask_text(rows, options, column, "__masked", "__found", tags, "__allowed")
        asked = F.array_distinct(F.transform("__found", lambda r: checks.allowed_form(r["original"])))
        return new.withColumn("__asked", asked).drop(*([] if replacements else ["__found"]))

    rest = written(masked(df.withColumn("__allowed", F.array().cast("array<string>"))).withColumn("__row", F.monotonically_increasing_id()), "masked")
    done: list[DataFrame] = []
    while True:
        asked = rest.select("__row", F.explode("__asked").alias("__word"))
        fresh = written(lookup(asked, words, "__word", "__listed").where("__listed").groupBy("__row").agg(F.collect_set("__word").alias("__more")), "allowed")
        done.append(rest.join(fresh, "__row", "left_anti"))
        if fresh.isEmpty():
            break
        again = rest.join(fresh, "__row").withColumn("__allowed", F.concat("__allowed", "__more"))
        rest = written(masked(again.drop("__more", "__masked", "__found", "__asked")), "masked")
    kept = [c for c in df.columns if c not in (out or column, replacements)]
    columns = [F.col("__masked").alias(out or column), *([F.col("__found").alias(replacements)] if replacements else [])]
    return reduce(DataFrame.unionByName, done).select(*kept, *columns)


def mask_nested(df: DataFrame, options: Options, column: str, depth: int, tags: list[str] | None = None, replacements: str | None = None) -> DataFrame:
    """Masks a column of strings in `depth` nested arrays, in place; `replacements` has each string's, nested alike."""

    def at(value: Column, level: int, f) -> Column:
        return f(value) if level == 0 else F.transform(value, lambda x: at(x, level - 1, f))

    state = df.withColumn("__state", at(F.col(column), depth, start_state))
    for rule in mask_steps(options, tags):
        state = state.withColumn("__state", at(F.col("__state"), depth, lambda s, rule=rule: _rule_step(s, rule, options)))
    state = settled(state, "__state").withColumn(column, at(F.col("__state"), depth, lambda s: s["text"]))
    if replacements:
        state = state.withColumn(replacements, at(F.col("__state"), depth, lambda s: s["found"]))
    return state.drop("__state")


def mask_column(df: DataFrame, column: str, tag: str, options: Options, strategy: str | None = None, out: str | None = None) -> DataFrame:
    """Masks all values of a column as one declared tag."""
    return df.withColumn(out or column, masked_value(F.col(column), tag, options, strategy or options.strategy(tag))["out"])
