"""Masking of structured documents: typed columns, flattened documents and text of any shape."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logveil.functions.jsonscan import pieces, split_lines
from logveil.operators.classify import classified
from logveil.operators.mask import REPLACEMENT, mask_nested, mask_text, masked_value, settled
from logveil.plans.options import ContextRule, Options


def plain_key(key: str) -> str:
    return key.lower().translate(str.maketrans("", "", "_-."))


def plain_path(path: str) -> str:
    return re.sub(r"[^0-9A-Za-z]+", "", path).lower()


def context_rule(keys: list[str], options: Options) -> ContextRule | None:
    """The first context rule for a field: by key, by a path that ends on a key's boundary, or by expression."""
    for rule in options.context_rules:
        if not rule.enabled:
            continue
        if rule.field and plain_key(rule.field) == plain_key(keys[-1]):
            return rule
        if rule.path:
            wanted = plain_path(rule.path)
            if wanted and any(plain_path("".join(keys[i:])) == wanted for i in range(len(keys))):
                return rule
        if rule.field_pattern and re.search(rule.field_pattern, keys[-1], re.IGNORECASE):
            return rule
    return None


def key_tag(keys: list[str], options: Options) -> str | None:
    """The tag of a sensitive field's values of no format; None for other fields.

    Its key counts, and its whole path, with or without the column that holds the document.
    """
    names = {plain_key(keys[-1]), "".join(plain_key(k) for k in keys), "".join(plain_key(k) for k in keys[1:])}
    if not any(plain_key(k) in names for k in options.sensitive_keys):
        return None
    return next((tag for k, tag in options.key_hints.items() if plain_key(k) in names), "SENSITIVE")


def _key_masked(value: Column, keys: list[str], options: Options) -> Column | None:
    """A sensitive field's value masked, or None if it is text like any other."""
    rule, tag = context_rule(keys, options), key_tag(keys, options)
    if rule is not None:
        new = masked_value(value, rule.tag.upper(), options, rule.strategy)["out"]
    elif tag is not None:
        new = masked_value(value, classified(value, options, tag), options)["out"]
    else:
        return None
    return F.when(value == "", value).otherwise(new)


def mask_typed(df: DataFrame, options: Options, columns: list[str] | None = None, free_text: bool = True) -> DataFrame:
    """Masks the string leaves of columns of known schema; the schema is walked once, on the driver.

    Leaves under sensitive keys are masked as values, others as free text (or left, with free_text
    false).  Elements of arrays have their array's path and are free text; values of maps are matched
    by their keys at run time.  Other types pass through.
    """
    chosen = columns or df.columns
    leaves: list[tuple[str, Column, int]] = []

    def free(read: Column, depth: int, index: list[Column]) -> Column:
        """A free-text leaf: read by `read`, masked in a column of its own and picked out by index."""
        name = f"__leaf{len(leaves)}"
        leaves.append((name, read, depth))
        out = F.col(name)
        for i in index:
            out = F.get(out, i)
        return out

    def over(read: Column, depth: int, f) -> Column:
        return f(read) if depth == 0 else F.transform(read, lambda x: over(x, depth - 1, f))

    def walk(kind: T.DataType, value: Column, read: Column, depth: int, index: list[Column], keys: list[str], in_array: bool) -> Column:
        if isinstance(kind, T.StringType):
            masked = None if in_array else _key_masked(value, keys, options)
            if masked is not None:
                return masked
            return free(read, depth, index) if free_text else value
        if isinstance(kind, T.StructType):
            fields = [walk(f.dataType, value[f.name], over(read, depth, lambda x, n=f.name: x[n]), depth, index, [*keys, f.name], False).alias(f.name) for f in kind.fields]
            return F.when(value.isNotNull(), F.struct(*fields))
        if isinstance(kind, T.ArrayType):
            return F.transform(value, lambda x, i: walk(kind.elementType, x, read, depth + 1, [*index, i], keys, True))
        if isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType) and isinstance(kind.valueType, T.StringType):
            return F.transform_values(value, lambda k, v: _by_run_time_key(k, v, keys, options))
        return value

    built = {c: walk(df.schema[c].dataType, F.col(c), F.col(c), 0, [], [c], False) for c in chosen}
    out = df
    for name, read, _ in leaves:
        out = out.withColumn(name, read)
    for name, _, depth in leaves:
        out = mask_nested(out, options, name, depth) if depth else mask_text(out, options, name)
    return out.select(*(built[c].alias(c) if c in built else F.col(c) for c in df.columns))


def _by_run_time_key(key: Column, value: Column, above: list[str], options: Options) -> Column:
    name = F.translate(F.lower(key), "_-.", "")
    full = F.concat(F.lit("".join(plain_key(k) for k in above)), name)
    sensitive = sorted({plain_key(k) for k in options.sensitive_keys})
    hints: dict[str, str] = {}
    for k, tag in options.key_hints.items():
        hints.setdefault(plain_key(k), tag)
    table = F.create_map(*(F.lit(x) for pair in hints.items() for x in pair))
    tag = F.coalesce(table[name], table[full], F.lit("SENSITIVE"))
    hit = (name.isin(*sensitive) | full.isin(*sensitive)) & (value != "")
    return F.when(hit, masked_value(value, classified(value, options, tag), options)["out"]).otherwise(value)


def flatten(df: DataFrame, column: str, id: str) -> DataFrame:
    """Documents in a JSON text column to (id, path, key, leaf) rows; invalid documents give none.

    A level of all documents is exploded at a time, until no document has a deeper one.  Keys with a
    dot, bracket, quote or backslash are quoted in the path: $['a.b'].
    """
    level = df.select(id, F.lit("$").alias("path"), F.lit("").alias("key"), F.try_parse_json(column).alias("v")).where("v is not null")
    found: list[DataFrame] = []
    while True:
        kind = F.schema_of_variant("v")
        inner = kind.startswith("OBJECT") | kind.startswith("ARRAY")
        found.append(level.where(~inner).select(id, "path", "key", F.col("v").cast("string").alias("leaf")))
        deeper = level.where(inner)
        if deeper.isEmpty():
            break
        deeper.createOrReplaceTempView("__logveil_level")
        sql = f"select t.`{id}`, t.path, t.key as above, e.pos, e.key as k, e.value as v from __logveil_level t, lateral variant_explode(t.v) e"
        rows = df.sparkSession.sql(sql)
        quoted = F.concat(F.lit("['"), F.replace(F.replace("k", F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("']"))
        named = F.when(F.col("k").rlike(r"^[^.\[\]'\\]+$"), F.concat(F.lit("."), F.col("k"))).otherwise(quoted)
        step = F.when(F.col("k").isNotNull(), named).otherwise(F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]")))
        level = rows.select(id, F.concat("path", step).alias("path"), F.coalesce("k", "above").alias("key"), "v")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def with_hints(flat: DataFrame, options: Options) -> DataFrame:
    """Adds the tag that a flattened leaf's key stands for (null: not sensitive), by a join with the key list."""
    rows = [(plain_key(k), key_tag([k], options)) for k in options.sensitive_keys]
    table = flat.sparkSession.createDataFrame(sorted(set(rows)), "__key string, hint string").dropDuplicates(["__key"])
    name = F.translate(F.lower("key"), "_-.", "")
    return flat.join(F.broadcast(table), name == F.col("__key"), "left").drop("__key")


def mask_any(df: DataFrame, options: Options, column: str = "text", replacements: str | None = None, begins: str | None = None) -> DataFrame:
    """Masks text of any shape in place: a JSON document, JSON Lines, or free text with objects in it.

    Strings under context rules and sensitive keys are masked as values, all others as free text, and so
    is what stands between documents.  Arrays are documents where the text is one, or JSON Lines; in
    other text only objects are, from a line's beginning on and over any number of lines.  Numbers and
    what stands around documents keep their spelling.  A document of one line stays one line, others are
    indented.  One Arrow function within the row finds the strings; masking and putting together are
    projections, and nothing is shuffled or joined.  Of keys that occur twice in an object the last
    counts; documents nested deeper than Python's stack are free text.  Null stays null.
    `replacements` names a column for what was replaced, as in mask_text; `begins` one with the brackets
    that begin documents, for parts of a text that is known as a whole (see openings).
    """
    taken = df.withColumn("__parts", _take_apart(options)(F.col(column), F.col(begins) if begins else F.lit(None).cast("string")))
    taken = taken.withColumn("__free", F.transform("__parts", lambda p: F.when(p["kind"] == _FREE, p["value"])))
    masked = mask_nested(taken, options, "__free", 1, replacements="__found")
    chosen = [r for r in options.context_rules if r.enabled]

    # pairs of arrays, as an array that is picked from by number may be computed for each element
    def new(part: Column, free: Column) -> Column:
        value = part["value"]
        out = F.when(part["kind"] == _SENSITIVE, masked_value(value, classified(value, options, part["tag"]), options))
        for k, rule in enumerate(chosen):
            out = out.when(part["kind"] == _RULE + k, masked_value(value, rule.tag.upper(), options, rule.strategy))
        return out.otherwise(F.struct(free.alias("out"), F.lit(None).cast(REPLACEMENT).alias("replacement")))

    def written(part: Column, new: Column) -> Column:
        text = F.when(part["quoted"], _quoted(new["out"])).otherwise(new["out"])
        return F.concat(part["before"], F.coalesce(text, F.lit("")))

    values = settled(masked.withColumn("__new", F.zip_with("__parts", "__free", new)), "__new")
    done = values.withColumn(column, F.when(F.col("__parts").isNotNull(), F.array_join(F.zip_with("__parts", "__new", written), "")))
    kept = df.columns
    if replacements:
        own = F.filter(F.transform("__new", lambda x: x["replacement"]), lambda r: r.isNotNull())
        every = F.concat(own, F.flatten(F.transform("__found", lambda f: F.coalesce(f, F.array().cast(f"array<{REPLACEMENT}>")))))
        done = done.withColumn(replacements, F.coalesce(every, F.array().cast(f"array<{REPLACEMENT}>")))
        kept = [*(c for c in kept if c != replacements), replacements]
    return done.select(*kept)


def _quoted(value: Column) -> Column:
    """A string as JSON writes it."""
    listed = F.to_json(F.array(value))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def mask_schemaless(df: DataFrame, options: Options, column: str, id: str | None = None) -> DataFrame:
    """The same as mask_any; documents need no id."""
    return mask_any(df, options, column)


#: Kinds of strings: what stands behind the last one, free text, under a sensitive key, and (from this number on) under a context rule.
_END, _FREE, _SENSITIVE, _RULE = -1, 0, 1, 2
_PART = T.ArrayType(T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("tag", T.StringType()), T.StructField("value", T.StringType()), T.StructField("before", T.StringType()), T.StructField("quoted", T.BooleanType())]))


class _Raw(str):
    """A number or constant as it is written."""


def openings(text: str) -> str:
    """The brackets that begin documents in a text: both where it is one document or JSON Lines, in other text that of objects."""
    bare = text.lstrip()
    if bare[:1] not in ("{", "["):
        return "{" if "{" in bare else ""
    full = lambda: (line.lstrip() for line in split_lines(text) if line.strip())
    if len(list(islice(full(), 2))) == 1 or all(line[0] in "{[" for line in full()):
        return "{["
    return "{[" if len(list(islice((None for _, chunk in pieces(text) if chunk.strip()), 2))) == 1 else "{"


def _documents(text: str, begins: str) -> Iterator[tuple[str, object]]:
    """A text as (chunk, JSON value or None for free text)."""
    for kind, chunk in pieces(text, begins) if begins else [("text", text)]:
        value = None
        if kind == "json":
            try:
                value = json.loads(chunk, parse_float=_Raw, parse_int=_Raw, parse_constant=_Raw)
            except (ValueError, RecursionError):
                value = None
        yield chunk, value


def _take_apart(options: Options):
    known: dict[tuple[str, ...], tuple[int, str | None]] = {}
    chosen = [r for r in options.context_rules if r.enabled]

    def kind(keys: tuple[str, ...]) -> tuple[int, str | None]:
        if not keys:
            return _FREE, None
        if keys not in known:
            if len(known) > 100_000:
                known.clear()
            rule, tag = context_rule(list(keys), options), key_tag(["", *keys], options)
            known[keys] = (_RULE + chosen.index(rule), None) if rule is not None else (_SENSITIVE, tag) if tag is not None else (_FREE, None)
        return known[keys]

    def part(number: int, tag: str | None, value: str, before: list[str], quoted: bool) -> dict:
        made = {"kind": number, "tag": tag, "value": value, "before": "".join(before), "quoted": quoted}
        before.clear()
        return made

    def written(value, keys: tuple[str, ...], in_array: bool, pad: str | None, level: int, before: list[str], parts: list[dict]) -> None:
        """Writes a document anew, up to each string and behind it."""
        if isinstance(value, str) and not isinstance(value, _Raw):
            number, tag = kind(keys) if value and not in_array else (_FREE, None)
            # half of a surrogate pair is no text
            parts.append(part(number, tag, value.encode("utf-8", "replace").decode("utf-8") if _HALF.search(value) else value, before, True))
            return
        if not isinstance(value, dict | list) or not value:
            before.append(str(value) if isinstance(value, _Raw) else json.dumps(value))
            return
        opening, closing = "{}" if isinstance(value, dict) else "[]"
        first, other, last = (opening, ", ", closing) if pad is None else (f"{opening}\n{pad * level}", f",\n{pad * level}", f"\n{pad * (level - 1)}{closing}")
        before.append(first)
        for i, (key, inner) in enumerate(value.items() if isinstance(value, dict) else ((None, v) for v in value)):
            if i:
                before.append(other)
            if key is not None:
                name = json.dumps(key, ensure_ascii=False)
                before.append(f"{json.dumps(key) if _HALF.search(name) else name}: ")
            written(inner, keys if key is None else (*keys, key), key is None, pad, level + 1, before, parts)
        before.append(last)

    @F.pandas_udf(_PART)
    def take(texts: pd.Series, begins: pd.Series) -> pd.Series:
        out = []
        for text, brackets in zip(texts, begins, strict=True):
            if text is None:
                out.append(None)
                continue
            parts: list[dict] = []
            before: list[str] = []
            for chunk, value in _documents(text, openings(text) if brackets is None else brackets):
                more: list[dict] = []
                behind = list(before)
                try:
                    if value is not None:
                        written(value, (), False, "  " if "\n" in chunk else None, 1, behind, more)
                except RecursionError:
                    value = None
                if value is None:
                    more = [part(_FREE, None, chunk, before, False)]
                    behind = []
                parts += more
                before = behind
            parts.append(part(_END, None, "", before, False))
            out.append(parts)
        return pd.Series(out, dtype=object)

    return take


_HALF = re.compile("[\ud800-\udfff]")
