"""Connected components of a link table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logveil.llm.exchange import cut, few


def components(links: DataFrame) -> DataFrame:
    """Links (a, b) of longs to (node, component): the smallest node that can be reached.

    In each round every node points to the neighbour (or itself) of the lowest rank, and
    links are carried over to what their ends point to.  Ranks are the nodes themselves in
    even rounds, which joins groups around their smallest node at once, and a hash in odd
    ones, after which about a quarter of the nodes or more is gone, in chains too; so the
    rounds grow with the logarithm of the nodes.  Ranks are compared with map-side
    aggregation, and a hub of very many links is a join key that Spark can split.  Up to
    `exchange.FEW` pointers are broadcast.  An empty link table gives an empty result.
    """
    edges = cut(_undirected(links))
    rounds: list[DataFrame] = []
    while not edges.isEmpty():
        rank = F.xxhash64(F.lit(len(rounds)), "b") if len(rounds) % 2 else F.col("b")
        ends = edges.select(F.explode(F.array(*(F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x in "ab" for y in "ab"))).alias("e")).select("e.*")
        points = cut(ends.groupBy("a").agg(F.min(F.struct(rank.alias("rank"), "b")).alias("to")).select(F.col("a").alias("node"), F.col("to.b").alias("at")))
        rounds.append(few(points))
        carried = edges.join(rounds[-1].toDF("a", "x"), "a").join(rounds[-1].toDF("b", "y"), "b")
        edges = cut(_undirected(carried.select(F.col("x").alias("a"), F.col("y").alias("b"))))
    if not rounds:
        return edges.toDF("node", "component")
    found = rounds[0]
    for later in rounds[1:]:
        found = found.join(later.toDF("at", "end"), "at", "left").select("node", F.coalesce("end", "at").alias("at"))
    found = cut(found)
    least = cut(found.groupBy("at").agg(F.min("node").alias("component")))
    return cut(found.join(few(least), "at").select("node", "component"))


def _undirected(links: DataFrame) -> DataFrame:
    return links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
