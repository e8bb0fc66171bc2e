"""Connected components of a graph held as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_table, drop_tables


def connected_components(edges: DataFrame, max_rounds: int = 60, rows: int | None = None) -> DataFrame:
    """Columns node, root (the smallest node reachable) for edges (a, b) of longs.

    Alternating star contraction: every round links neighbours to the smallest
    neighbour, first those above a node, then those below. Edge tables are
    written to the shared folder each round, to no more files than their number
    calls for; nothing is collected but a count and a checksum. rows, if given,
    is at least about how many edges there are. Null ends are ignored; no edges
    give an empty result.
    """
    edges = edges.where("a is not null and b is not null and a <> b").select("a", "b")
    edges = as_table(edges.distinct(), "edges", rows)
    before, n = None, edges.count()
    if not n:
        return edges.toDF("node", "root")
    for _ in range(max_rounds):
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("u"), F.col("m").alias("v")).where("u <> v")
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select("v", "m").where("v <> m").union(low.select("u", "m")).toDF("a", "b").distinct()
        new = as_table(small, "edges", n)
        drop_tables(edges)
        edges = new
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before, n = state, state[0]
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())
