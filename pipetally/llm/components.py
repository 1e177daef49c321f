"""Connected components of an edge list by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipetally.llm.shared import few, written

#: A table of least neighbours of at most this many rows (two values each) is broadcast, so that no hub is dealt to one task.
BROADCAST_ROWS = 200_000


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # only a node with a smaller neighbour moves the others; the least of all, however many edges it has, stays as it is
    least = both.groupBy("u").agg(F.min("v").alias("m")).filter("m < u")
    up = both.filter("v > u")
    moved = up.join(few(least, BROADCAST_ROWS), "u", "left")
    return moved.select(F.col("v").alias("u"), F.coalesce("m", "u").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    # every edge is (greater, smaller)
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    across = edges.join(few(least, BROADCAST_ROWS), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
    return across.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node that is not its own component's smallest node.

    ``edges`` has two columns of one orderable type, ``a`` and ``b``; self-loops, repeats,
    nulls (dropped) and either direction are fine, and an empty list gives an empty result.
    Each round is written to the shared folder, so lineage stays short and lost executors cost
    one round at most.  Minima are combined before the shuffle; a hub's edges meet them in a
    broadcast join up to a checked size, and beyond it in a join that AQE splits.  The number of
    rounds grows with the logarithm of the longest chain.
    """
    e = edges.filter("a is not null and b is not null and a <> b")
    e = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, before = written(e, "edges"), None
    while True:
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if now["n"] == 0 or now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = now
        big = written(_large_star(e), "edges")
        e = written(_small_star(big), "edges")
