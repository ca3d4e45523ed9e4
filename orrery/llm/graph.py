"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.session import written


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node of its component for each node of an edge between different nodes.

    Min-label hooking with pointer jumping: each round replaces every edge by edges to the smallest neighbour of its ends,
    so paths shorten by a factor each round. Each round is two shuffles of the edges and is written to the shared folder,
    which cuts lineage; nothing but a count comes to the driver. Loops and repeated edges are allowed; null ends are left
    out; an empty table gives an empty result.
    """
    pair = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b")
    now = written(pair.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(rounds):
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))  # smallest of each closed neighbourhood
        # large star: neighbours larger than a node go to the node's smallest neighbour; small star: the others do
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        small_low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_low, "a")
        new = small.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionAll(small.select("a", F.col("m").alias("b"))).distinct()
        new = written(new, "edges")
        if new.join(now, ["a", "b"], "left_anti").isEmpty() and now.join(new, ["a", "b"], "left_anti").isEmpty():
            break
        now = new
    else:
        raise RuntimeError("components have not settled")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
