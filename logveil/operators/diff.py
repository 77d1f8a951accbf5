"""Before and after: spans, changed lines, and rows of a unified diff."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logveil.functions.regex import bind, extract_all, gaps, starts
from logveil.operators.joins import lookup
from logveil.sources.shared import written

SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def merge_spans(spans: Column, gap: int = 0) -> Column:
    """Spans (start, end) of one row, those that overlap or lie within `gap` merged."""
    empty = F.array().cast("array<struct<start:int,end:int>>")
    pair = lambda a, b: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"))

    def add(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(pair(last["start"], F.greatest(last["end"], s["end"]))))
        return F.when((F.size(done) > 0) & (s["start"] <= F.get(done, F.size(done) - 1)["end"] + gap), joined).otherwise(F.concat(done, F.array(pair(s["start"], s["end"]))))

    return F.aggregate(F.array_sort(F.transform(spans, lambda s: pair(s["start"], s["end"]))), empty, add)


def merge_span_rows(rows: DataFrame, by: str, gap: int = 0) -> DataFrame:
    """The same for a table (by, start, end), as islands over a window."""
    w = Window.partitionBy(by).orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("__new", F.when(before.isNull() | (F.col("start") > before + gap), 1).otherwise(0))
    grouped = marked.withColumn("__g", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(by, "__g").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("__g")


def changed_lines(before: DataFrame, after: DataFrame, by: str = "path", number: str = "line_no", line: str = "line") -> DataFrame:
    """Lines that differ on the two sides (masking keeps the number of lines)."""
    a = before.select(by, number, F.col(line).alias("before"))
    b = after.select(by, number, F.col(line).alias("after"))
    return a.join(b, [by, number]).where("not (before <=> after)")


def diff_rows(before: DataFrame, after: DataFrame, context: int = 3, by: str = "path", number: str = "line_no", line: str = "line") -> DataFrame:
    """Rows of a unified diff: (by, number, op, text) with op `-`, `+` or `ctx` for lines near a change."""
    a = before.select(by, number, F.col(line).alias("before"))
    both = a.join(after.select(by, number, F.col(line).alias("after")), [by, number])
    changed = ~F.col("before").eqNullSafe(F.col("after"))
    w = Window.partitionBy(by).orderBy(number).rowsBetween(-context, context)
    near = both.withColumn("__c", changed).withColumn("__near", F.max("__c").over(w)).where("__near")
    pair = lambda op, text: F.struct(F.lit(op).alias("op"), F.col(text).alias("text"))
    rows = F.when(F.col("__c"), F.array(pair("-", "before"), pair("+", "after"))).otherwise(F.array(pair("ctx", "before")))
    return near.select(by, number, F.explode(rows).alias("r")).select(by, number, "r.op", "r.text")


#: A run of letters, digits and underscores.
RUN = r"\w+"
#: A value is first looked up by its first runs, as many as the largest of these that it has.
LEVELS = (1, 2, 4)
#: Keys of values that are told as literals, within a text's row.
LITERALS = 1000
#: Bytes of values that a broadcast may hold, with this much for a value besides its characters.
BROADCAST, BESIDES = 1 << 26, 100


def _stretch(runs: Column, between: Column, first: Column, n: int) -> Column:
    """A text's n runs from one on, with what stands between them; null if it has fewer."""
    parts = [F.get(runs, first)]
    for k in range(1, n):
        parts += [F.get(between, first + k), F.get(runs, first + k)]
    return F.concat(*parts)


def _runs(df: DataFrame, column: str) -> DataFrame:
    """Adds the runs of a text and what stands before, between and behind them, computed once."""
    cut = F.struct(extract_all(F.col(column), RUN).alias("m"), gaps(F.col(column), RUN).alias("g"))
    return df.withColumn("__cut", F.explode(F.array(cut))).where(F.size("__cut.m") > 0)


def _by_run(values: DataFrame) -> DataFrame:
    """Values that hold a run: (value, tag, n runs, core from the first to the last run, head, tail, level and key of the first runs)."""
    m, g = F.col("__cut.m"), F.col("__cut.g")
    cut = _runs(values.select("value", "tag").distinct(), "value")
    head, tail, n = F.element_at(g, 1), F.element_at(g, -1), F.size(m)
    key, most = F.lit(None).cast("long"), F.lit(None).cast("int")
    for level in LEVELS:
        key = F.when(n >= level, F.xxhash64(F.lit(level), _stretch(m, g, F.lit(0), level))).otherwise(key)
        most = F.when(n >= level, F.lit(level)).otherwise(most)
    core = F.substring(F.col("value"), F.length(head) + 1, F.length("value") - F.length(head) - F.length(tail))
    return cut.select("value", "tag", n.alias("n"), core.alias("core"), head.alias("head"), tail.alias("tail"), most.alias("level"), key.alias("key"))


def _apart(found: Column) -> Column:
    """Spans sorted by start, the longest first, without those that begin within one that was kept."""
    none = F.struct(F.lit(0).alias("end"), F.slice(found, 1, 0).alias("kept"))
    step = lambda done, s: F.when(s["start"] >= done["end"], F.struct(s["end"].alias("end"), F.concat(done["kept"], F.array(s)).alias("kept"))).otherwise(done)
    return F.aggregate(found, none, step, lambda done: done["kept"])


def value_spans(df: DataFrame, values: DataFrame, column: str = "text", id: str = "doc_id") -> DataFrame:
    """(id, start, end, value, tag): where values (value, tag) stand in texts, the longest at a place.

    No letter, digit or underscore may stand before or behind a value; from left to right, a span that
    begins within one found before is left out; of several tags of a value the smallest is taken.  Values
    without any letter, digit or underscore are not looked for; null texts and values give nothing; rows
    that share id and text give their spans once.

    A value begins and ends at the ends of runs of a text, so it is found by equality.  Hashes of a text's first
    one, two and four runs at every place (as many as values have) tell where a value may begin and how many runs
    it has; only for these the runs themselves are looked up.  Few keys are told within a text's row, and values
    of 64 MB come by broadcast, so that no hash of a word is shuffled.  Of more values, texts are joined with
    their places by id and never with values, and words or values that stand in most texts make no task longer
    than others.
    """
    texts = df.where(F.col(column).isNotNull()).select(F.col(id).alias("__id"), F.xxhash64(column).alias("__h"), F.col(column).alias("__text"))
    m, g = F.col("__cut.m"), F.col("__cut.g")
    known = written(_by_run(values), "values")
    levels = sorted(r["level"] for r in known.select("level").distinct().collect())
    small = known.agg(F.coalesce(F.sum(F.length("value") + BESIDES), F.lit(0)) <= BROADCAST).first()[0]
    keys = known.select("level", "key", "n").distinct().limit(LITERALS + 1).collect()
    key = lambda i, n: F.xxhash64(F.lit(n), _stretch(m, g, i, n))
    within = lambda i, ns: F.transform(F.filter(ns, lambda n: i + n <= F.size(m)), lambda n: F.struct(i.alias("i"), n.alias("n")))

    if len(keys) <= LITERALS:
        ns = {level: {} for level in levels}
        for r in keys:
            ns[r["level"]].setdefault(r["key"], []).append(r["n"])

        def begun_at(i: Column, level: int) -> Column:
            table = F.create_map(*(x for k, v in ns[level].items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
            return F.when(key(i, level).isin(*ns[level]), within(i, table[key(i, level)])).otherwise(F.array().cast("array<struct<i:int,n:int>>"))

        found = lambda i: F.concat(*(begun_at(i, level) for level in levels)) if levels else F.array().cast("array<struct<i:int,n:int>>")
        placed = _runs(texts, "__text").withColumn("__p", F.explode(F.array(F.flatten(F.transform(F.sequence(F.lit(0), F.size(m) - 1), found)))))
    else:
        texts = _runs(texts.groupBy("__id", "__h").agg(F.min("__text").alias("__text")), "__text")
        counts = known.groupBy("key").agg(F.collect_set("n").alias("ns"))
        hashes = lambda i: F.array(*(F.when(i + n <= F.size(m), F.struct(i.alias("i"), key(i, n).alias("key"))) for n in levels))
        every = texts.select("__id", "__h", F.explode(F.flatten(F.transform(F.sequence(F.lit(0), F.size(m) - 1), hashes))).alias("p")).where("p is not null").select("__id", "__h", "p.i", "p.key")
        begun = every.join(F.broadcast(counts), "key") if small else lookup(every, counts, "key", "ns").where("ns is not null")
        at = begun.groupBy(F.col("__id").alias("__of"), F.col("__h").alias("__hash")).agg(F.collect_set(F.struct("i", "ns")).alias("places"))
        placed = texts.join(at, F.col("__id").eqNullSafe(F.col("__of")) & (F.col("__h") == F.col("__hash")))
        placed = placed.withColumn("__p", F.array_distinct(F.flatten(F.transform("places", lambda p: within(p["i"], p["ns"])))))

    def stretch(p: Column, at: Column) -> Column:
        i, n = p["i"], p["n"]
        core = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.concat(F.when(k == 0, "").otherwise(F.get(g, i + k)), F.get(m, i + k))), "")
        return F.struct(F.get(at, i).alias("at"), core.alias("core"), F.get(g, i).alias("before"), F.get(g, i + n).alias("behind"), (i == 0).alias("first"), (i + n == F.size(m)).alias("last"))

    stretches = F.when(F.size("__p") > 0, bind(starts(g, m), lambda at: F.transform("__p", lambda p: stretch(p, at))))
    tried = placed.select("__id", "__h", F.explode(stretches).alias("__t")).select("__id", "__h", "__t.*")
    cores = known.groupBy("core").agg(F.collect_set(F.struct("value", "tag", "head", "tail")).alias("vs"))
    # written, as counting the frequent ones among them would else search the texts again
    told = tried.join(F.broadcast(cores), "core") if small else lookup(written(tried, "places"), cores, "core", "vs").where("vs is not null")
    told = told.withColumn("v", F.explode("vs"))

    # what a value has before its first run and behind its last one stands there, and no run touches it
    clear = lambda part, gap, end, ends: (part == "") | ends & ((part != gap) | end)
    fits = clear(F.col("v.head"), F.col("before"), F.col("first"), F.col("before").endswith(F.col("v.head"))) & clear(F.col("v.tail"), F.col("behind"), F.col("last"), F.col("behind").startswith(F.col("v.tail")))
    start = (F.col("at") - F.length("v.head")).cast("int")
    span = F.struct(start.alias("start"), (-F.length("v.value")).alias("order"), F.col("v.tag").alias("tag"), (start + F.length("v.value")).cast("int").alias("end"), F.col("v.value").alias("value"))
    spans = told.where(fits).groupBy("__id", "__h").agg(F.array_sort(F.collect_set(span)).alias("s"))
    return spans.select(F.col("__id").alias(id), F.explode(_apart(F.col("s"))).alias("s")).select(id, "s.start", "s.end", "s.value", "s.tag")


def token_diff(df: DataFrame, before: str, after: str, most: int = 20_000) -> DataFrame:
    """Adds spans_before and spans_after of two texts' differing tokens; beyond `most` characters, of differing lines."""

    @F.pandas_udf(T.StructType([T.StructField("before", SPANS), T.StructField("after", SPANS)]))
    def spans(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        import re

        def one(x: str, y: str) -> tuple[list, list]:
            pattern = r"\n|[^\n]+" if len(x) + len(y) > most else r"\w+|\s+|[^\w\s]"
            u, v = re.findall(pattern, x), re.findall(pattern, y)
            at, to = [0], [0]
            for s, places in ((u, at), (v, to)):
                for t in s:
                    places.append(places[-1] + len(t))
            ops = [o for o in difflib.SequenceMatcher(None, u, v, autojunk=False).get_opcodes() if o[0] != "equal"]
            return [{"start": at[o[1]], "end": at[o[2]]} for o in ops if o[2] > o[1]], [{"start": to[o[3]], "end": to[o[4]]} for o in ops if o[4] > o[3]]

        out = [one(x or "", y or "") for x, y in zip(a, b, strict=True)]
        return pd.DataFrame({"before": [o[0] for o in out], "after": [o[1] for o in out]})

    return df.withColumn("__d", spans(before, after)).withColumn("spans_before", F.col("__d.before")).withColumn("spans_after", F.col("__d.after")).drop("__d")


def line_numbers_changed(df: DataFrame, before: str, after: str) -> DataFrame:
    """Adds the numbers of lines that differ on either side, for texts whose number of lines may differ."""
    numbers = T.ArrayType(T.IntegerType())

    @F.pandas_udf(T.StructType([T.StructField("before", numbers), T.StructField("after", numbers)]))
    def changed(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        left, right = [], []
        for x, y in zip(a, b, strict=True):
            ops = [o for o in difflib.SequenceMatcher(None, (x or "").split("\n"), (y or "").split("\n"), autojunk=False).get_opcodes() if o[0] != "equal"]
            left.append([n + 1 for o in ops for n in range(o[1], o[2])])
            right.append([n + 1 for o in ops for n in range(o[3], o[4])])
        return pd.DataFrame({"before": left, "after": right})

    return df.withColumn("__d", changed(before, after)).withColumn("lines_before", F.col("__d.before")).withColumn("lines_after", F.col("__d.after")).drop("__d")
