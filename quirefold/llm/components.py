"""Connected components by alternating large-star and small-star steps, in DataFrame operations.

Each round points every node at the least node it knows (large star: larger neighbours to the
least neighbour; small star: smaller neighbours and the node to the least).  Edges never grow in
number, and depth falls fast, so a few rounds end it.  A node with very many neighbours is the key of a
plain aggregate, combined where it is read, and of a join of two written tables, whose large
partitions adaptive execution splits; no group is gathered anywhere.
Every step is written to the shared folder, so a lost executor costs no more than a step, and removed when the next
one stands.

Defined results: edges of a node with itself and repeated edges count for nothing; an empty table gives no nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .shared import cut, release


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("least")), "least")
    out = cut(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v")).distinct(), "large-star")
    release(least)
    return out


def _small_star(edges: DataFrame, state: Observation) -> DataFrame:
    # After a large star, a node has few smaller neighbours: no table needs to stand between.
    least = edges.groupBy("u").agg(F.min("v").alias("least"))
    joined = edges.join(least, "u")
    moved = joined.where("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v")).unionByName(least.select("u", F.col("least").alias("v"))).distinct()
    # The table's size and the sum of its rows' hashes: where they stay, the table does.
    out = cut(moved.observe(state, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("hash")), "small-star")
    return out


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of every node of ``edges (u, v)`` of longs: the least node that links reach."""
    now = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while True:
        state = Observation()
        large = _large_star(now)
        after = _small_star(large, state)
        release(now, large)
        # A forest of stars: as many edges as nodes that are no centre, and no centre points on.
        now, known = after, (state.get["n"], state.get["hash"])
        if known == before:
            break
        before = known
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
