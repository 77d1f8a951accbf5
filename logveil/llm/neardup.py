"""MinHash near-dedup by a chosen-path set similarity join.

A document's set holds its distinct shingles of `size` words (lower-cased A-Z; a
shorter text is one shingle).  Documents with equal sets fall into one class, and
classes are joined:

* each of `TREES` independent trees sends a class down a path of minwise tokens,
  one for each level, chosen by that tree's and level's own hash;
* a node of at most `SMALL` classes compares all its pairs; a larger one branches
  by the next token;
* in a leaf that is still large after the last level, classes are compared with two
  leaders first, which joins groups of near copies in few links; then the classes outside
  the leaf's largest component are compared with all others of the leaf that are not in
  theirs, on the full sets, in blocks of bounded size, each pair in the first tree whose
  leaf it shares;
* pairs whose sizes or 1-bit minwise sketches rule a link out are passed over;
* candidates are confirmed on the full sets.

Two sets of similarity 0.8 share a node of depth d with probability 0.8^d in each
tree, so at depth 4 the trees miss one such pair in some thousands, and pairs of a
higher similarity or in smaller nodes less.  Links are joined into components.

Plan: the text is scanned once for sets' fingerprints and paths, and once more for
the full sets of candidates only.  Nodes are counted with map-side aggregation; those
above `SMALL` are marked by a join (broadcast up to `exchange.FEW`), so only small nodes
become groups in memory; a group of m copies gives m rows and not m squared pairs.  A large
leaf of m classes in many components is dealt out as pairs of blocks, so its sets
are sent once for each block: such a family costs m squared comparisons.  Up to
`exchange.FEW` ids of candidates are broadcast to pick their texts; more are joined.

Defined results: ids may be of any type with an order (other than integers they are
known by a 64-bit hash on the way); without words or text a set is empty and linked with nothing; a
row with a null doc_id takes no part (component_id null, kept true); rows that
share a doc_id count as one document when linked; ties go to the smallest doc_id;
an empty table gives an empty result; other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logveil.llm.components import components
from logveil.llm.exchange import cut, few, small_batches
from logveil.llm.textbytes import mix, slices, split_words, windows

TREES = 16
#: A tree's levels at which nodes are looked at; branching starts with two tokens.
DEPTHS = (2, 3, 4)
#: Classes of a node that are compared with each other.
SMALL = 16
#: Equal bits of 64 that two sketches have at least; at similarity 0.8 they have 57.6 on average, with a deviation of 2.4.
ALIKE = 45
SIZE = 5
PERCENT = 80
#: Classes and bytes of sets that make up one block of a large leaf, about.
BLOCK_CLASSES = 2048
BLOCK_BYTES = 12 << 20
_BLOCK = 1 << 15


def shingle_sets(column, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all documents' distinct shingles, each document's in order, and where each document begins."""
    words = split_words(column, lower=True)
    parts, hashes = [], words.hashes
    grams, at = windows(words, size)
    first = np.searchsorted(at, words.first)
    for doc, n in enumerate(words.counts.tolist()):
        if n >= size:
            own = np.sort(grams[first[doc] : first[doc + 1]])
            fresh = np.ones(len(own), dtype=bool)
            fresh[1:] = own[1:] != own[:-1]
            own = own[fresh]
        elif n:
            whole = np.uint64(n)
            for h in hashes[words.first[doc] : words.first[doc + 1]]:
                whole = mix(np.array([whole ^ h]), 3)[0]
            own = np.array([whole], np.uint64)
        else:
            own = np.zeros(0, np.uint64)
        parts.append(own)
    starts = np.concatenate(([0], np.cumsum([len(p) for p in parts], dtype=np.int64)))
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), starts


def _paths(sets: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Node keys of each non-empty set (sets x TREES x DEPTHS), and its sketch of one bit for each minwise token."""
    levels = DEPTHS[-1]
    seeds = mix(np.arange(1, 2 * TREES * levels + 1, dtype=np.uint64), 11)
    flips, factors = seeds[::2], seeds[1::2] | np.uint64(1)
    out = np.empty((len(starts) - 1, TREES * levels), np.uint64)
    doc = 0
    while doc < len(out):
        last = max(doc + 1, int(np.searchsorted(starts, starts[doc] + _BLOCK, side="right")) - 1)
        block, begin = sets[starts[doc] : starts[last]], starts[doc:last] - starts[doc]
        for k in range(TREES * levels):
            out[doc:last, k] = np.minimum.reduceat((block ^ flips[k]) * factors[k], begin)
        doc = last
    keys = np.empty((len(out), TREES, len(DEPTHS)), np.uint64)
    for tree in range(TREES):
        node = np.full(len(out), tree, np.uint64)
        for level in range(levels):
            node = mix(node ^ out[:, tree * levels + level], 5)
            if level + 1 in DEPTHS:
                keys[:, tree, DEPTHS.index(level + 1)] = node
    sketch = np.zeros(len(out), np.uint64)
    for k in range(TREES * levels):
        sketch |= (mix(out[:, k], 7) & np.uint64(1)) << np.uint64(k % 64)
    return keys.view(np.int64), sketch.view(np.int64)


def _fingerprints(sets: np.ndarray, starts: np.ndarray) -> list[pa.Array]:
    """Two sums over each set's hashes; equal sets have equal ones."""
    some = np.flatnonzero(np.diff(starts))
    prints = np.zeros((2, len(starts) - 1), np.int64)
    if len(some):
        for k in (0, 1):
            prints[k, some] = np.add.reduceat(mix(sets, 21 + k), starts[:-1][some]).view(np.int64)
    return [pa.array(prints[0]), pa.array(prints[1])]


_PRINTS = ["print1", "print2", "n_shingles"]
_PATHS = ", ".join(f"k{d}:long" for d in range(len(DEPTHS)))


def described(source: DataFrame, size: int, paths: bool) -> DataFrame:
    """Each document's fingerprints and number of shingles; with paths, for non-empty sets only, also its sketch and node keys."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                sets, starts = shingle_sets(batch.column("text"), size)
                columns = [batch.column("doc_id"), *_fingerprints(sets, starts), pa.array(np.diff(starts), pa.int64())]
                names = ["doc_id", *_PRINTS]
                if paths:
                    some = np.flatnonzero(np.diff(starts))
                    keys, sketch = _paths(sets, np.append(starts[:-1][some], len(sets))) if len(some) else (np.zeros((0, TREES, len(DEPTHS)), np.int64), np.zeros(0, np.int64))
                    node = pa.StructArray.from_arrays([pa.array(keys[:, :, d].ravel()) for d in range(len(DEPTHS))], names=[f"k{d}" for d in range(len(DEPTHS))])
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * TREES, pa.int32()), node)
                    columns = [c.take(pa.array(some)) for c in columns] + [pa.array(sketch), lists]
                    names += ["sketch", "paths"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, print1 long, print2 long, n_shingles long"
    return source.mapInArrow(describe, schema + (f", sketch long, paths array<struct<{_PATHS}>>" if paths else ""))


def candidates(classes: DataFrame) -> DataFrame:
    """Classes (rep, n_shingles, sketch, paths) to rows (a, b, leaf, low, high, n).

    Without a leaf: a distinct pair of classes to confirm, a < b.  With one: class a, of n shingles, stands in a large leaf
    with these leaders, the smallest and the largest class, which a group of near copies has in common in most trees.
    """
    rows = classes.select("rep", "n_shingles", "sketch", F.explode("paths").alias("p")).select("rep", "n_shingles", "sketch", "p.*")
    group = F.array_sort(F.collect_list(F.struct(F.col("rep").alias("id"), F.col("n_shingles").alias("n"), F.col("sketch").alias("s"))))
    found = []
    for depth in range(len(DEPTHS)):
        node = f"k{depth}"
        leaders = [F.min("rep").alias("low"), F.max("rep").alias("high")] if depth == len(DEPTHS) - 1 else []
        large = rows.groupBy(F.col(node).alias("large")).agg(F.count(F.lit(1)).alias("members"), *leaders).where(F.col("members") > SMALL).drop("members")
        marked = rows.join(few(cut(large)), F.col(node) == F.col("large"), "left")
        left = marked.where("large is null").groupBy(node).agg(group.alias("g")).where(F.size("g") > 1).select("g", F.posexplode("g").alias("i", "x"))
        pairs = left.select("x", F.explode(F.slice("g", F.col("i") + 2, F.size("g"))).alias("y"))
        fits = F.least("x.n", "y.n") * 100 >= F.greatest("x.n", "y.n") * PERCENT
        alike = 64 - F.bit_count(F.col("x.s").bitwiseXOR(F.col("y.s"))) >= ALIKE
        found.append(pairs.where(fits & alike).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")))
        rows = marked.where("large is not null")
        if depth < len(DEPTHS) - 1:
            rows = rows.drop(node, "large")
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    leaves = rows.select(F.col("rep").alias("a"), F.col("large").alias("leaf"), "low", "high", F.col("n_shingles").alias("n"))
    return every.where("a <> b").distinct().unionByName(leaves, allowMissingColumns=True)


def with_leaders(found: DataFrame) -> DataFrame:
    """The pairs among candidates, and those of each leaf's classes with its leaders."""
    chief = F.explode(F.array("low", "high")).alias("chief")
    led = found.where("leaf is not null").select("a", chief).select(F.least("a", "chief").alias("a"), F.greatest("a", "chief").alias("b"))
    return found.where("leaf is null").select("a", "b").unionByName(led.where("a <> b").distinct())


def full_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """The full sets (doc_id, shingles) of the wanted doc_ids (distinct)."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()  # equal rows of a task give one set
        for whole in batches:
            for batch in slices(whole):
                sets, starts = shingle_sets(batch.column("text"), size)
                ids, own = [], []
                for doc, (x, y, a, b) in enumerate(zip(batch.column("doc_id").to_pylist(), _fingerprints(sets, starts)[0].to_pylist(), starts[:-1], starts[1:], strict=True)):
                    if (x, y) not in seen:
                        seen.add((x, y))
                        ids.append(doc)
                        own.append(sets[a:b].tobytes())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(ids, pa.int64())), pa.array(own, pa.binary())], names=["doc_id", "shingles"])

    return docs.select("doc_id", "text").join(few(cut(wanted)), "doc_id", "left_semi").mapInArrow(collect, "doc_id long, shingles binary")


def leaf_links(found: DataFrame, labels: DataFrame, classes: DataFrame, docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """Links (a, b) between components, from the pairs of large leaves' classes that `labels` (node, component) has not joined.

    In each leaf, classes outside its largest component (strays) are compared with all its classes, block by block:
    a class is sent once for each block of strays, and a stray once more for each block of the leaf.
    """

    def compare(table: pa.Table) -> pa.Table:
        leaf = table.column("leaf")[0].as_py()
        rep, component, n = (table.column(c).to_numpy() for c in ("rep", "component", "n"))
        stray, guest = (table.column(c).to_numpy(zero_copy_only=False) for c in ("stray", "guest"))
        sketch = table.column("sketch").to_numpy().view(np.uint64)
        keys = np.array(table.column("leaves").to_pylist(), np.int64)
        earlier = keys[:, : int(np.argmax(keys[0] == leaf))]
        sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
        known, codes = np.unique(np.concatenate(sets), return_inverse=True)
        codes = np.split(codes, np.cumsum([len(x) for x in sets])[:-1])
        mark, joined, a, b = np.zeros(len(known), dtype=bool), component.copy(), [], []
        for i in np.flatnonzero(guest).tolist():
            wanted = ~guest & (joined != joined[i]) & (~stray | (rep < rep[i]))
            wanted &= np.minimum(n, n[i]) * 100 >= np.maximum(n, n[i]) * percent
            wanted &= 64 - np.bitwise_count(sketch ^ sketch[i]) >= ALIKE
            at = np.flatnonzero(wanted)
            at = at[~(earlier[at] == earlier[i]).any(axis=1)]
            if not len(at):
                continue
            mark[codes[i]] = True
            begin = np.cumsum([0] + [len(codes[j]) for j in at[:-1]])
            both = np.add.reduceat(mark[np.concatenate([codes[j] for j in at])], begin, dtype=np.int64)
            mark[codes[i]] = False
            for j in at[100 * both >= percent * (n[i] + n[at] - both)].tolist():
                if joined[j] != joined[i]:
                    a.append(min(component[i], component[j]))
                    b.append(max(component[i], component[j]))
                    joined[joined == joined[j]] = joined[i]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    def blocks(members: str, total: str):
        return F.ceil(F.greatest(F.col(members) / BLOCK_CLASSES, F.col(total) * 8 / BLOCK_BYTES)).cast("int")

    leaves = found.where("leaf is not null").select("leaf", F.col("a").alias("rep"), "n")
    placed = leaves.join(few(labels).withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    parts = placed.groupBy("leaf", "component").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("t"))
    largest = F.struct("m", "component", "t")
    mixed = parts.groupBy("leaf").agg(F.count(F.lit(1)).alias("parts"), F.sum("m").alias("m"), F.sum("t").alias("t"), F.max(largest).alias("main")).where("parts > 1")
    mixed = mixed.withColumn("sm", F.col("m") - F.col("main.m")).withColumn("st", F.col("t") - F.col("main.t"))
    mixed = few(cut(mixed.select("leaf", F.col("main.component").alias("main"), blocks("m", "t").alias("homes"), blocks("sm", "st").alias("guests"))))
    rows = cut(placed.join(mixed, "leaf").withColumn("stray", F.col("component") != F.col("main")))
    wanted = few(cut(rows.select("rep").distinct()))
    known = classes.join(wanted, "rep", "left_semi").select("rep", F.col("n_shingles").alias("n"), "sketch", F.transform("paths", lambda p: p[f"k{len(DEPTHS) - 1}"]).alias("leaves"))
    sets = full_sets(docs, wanted.withColumnRenamed("rep", "doc_id"), size).select(F.col("doc_id").alias("rep"), "shingles").withColumn("n", (F.octet_length("shingles") / 8).cast("long"))
    dealt = rows.join(known, ["rep", "n"]).where(F.array_contains("leaves", F.col("leaf"))).join(sets, ["rep", "n"])
    own = lambda count, seed: F.pmod(F.xxhash64("rep", F.lit(seed)), F.col(count)).cast("int")
    at_home = dealt.withColumn("guest", F.lit(False)).withColumn("home", own("homes", 1)).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("guests") - 1)))
    visiting = dealt.where("stray").withColumn("guest", F.lit(True)).withColumn("block", own("guests", 2)).withColumn("home", F.explode(F.sequence(F.lit(0), F.col("homes") - 1)))
    return at_home.unionByName(visiting.select(*at_home.columns)).groupBy("leaf", "home", "block").applyInArrow(compare, "a long, b long").distinct()


def confirm(pairs: DataFrame, docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """The pairs whose full sets have 100 * intersection >= percent * union."""

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                least, most = sorted((len(x), len(y)))
                both = 0
                if least * 100 >= percent * most:
                    merged = np.sort(np.concatenate((x, y)))
                    both = int(np.count_nonzero(merged[1:] == merged[:-1]))
                keep.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    wanted = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    sets = full_sets(docs, wanted, size)
    with_x = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x")), "a")
    with_both = with_x.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y")), "b")
    return with_both.mapInArrow(linked, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, size: int = SIZE, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the smallest doc_id reachable) and kept."""
    if not isinstance(docs.schema[id].dataType, T.IntegralType):
        return _with_other_ids(docs, size, text, id)
    small_batches(docs.sparkSession)
    source = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    identified = described(source, size, paths=True).where("doc_id is not null")
    classes = cut(identified.groupBy(*_PRINTS).agg(F.min("doc_id").alias("rep"), F.first("sketch").alias("sketch"), F.first("paths").alias("paths")))
    found = cut(candidates(classes))
    labels = components(confirm(with_leaders(found), source, size))
    late = few(components(leaf_links(found, labels, classes, source, size))).toDF("joined", "least")
    named = classes.join(few(labels), classes["rep"] == labels["node"], "left").withColumn("joined", F.coalesce("component", "rep"))
    named = named.join(late, "joined", "left").select(*_PRINTS, F.coalesce("least", "joined").alias("component_id"))
    members = described(source, size, paths=False)
    joined = members.where("n_shingles > 0 and doc_id is not null").join(named, _PRINTS).select("doc_id", "n_shingles", "component_id")
    alone = members.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return joined.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _with_other_ids(docs: DataFrame, size: int, text: str, id: str) -> DataFrame:
    """The same for ids of another type, which are known by a 64-bit hash on the way."""
    keyed = docs.select(F.col(id).alias("name"), F.when(F.col(id).isNotNull(), F.xxhash64(id)).alias("doc_id"), F.col(text).alias("text"))
    found = near_duplicates(keyed, size).drop("kept").join(keyed.where("doc_id is not null").select("doc_id", "name").distinct(), "doc_id", "left")
    least = found.groupBy("component_id").agg(F.min("name").alias("least"))
    named = found.join(least, "component_id", "left").select(F.col("name").alias("doc_id"), "n_shingles", F.col("least").alias("component_id"))
    return named.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
