"""Connected components of an edge table, wholly on DataFrames.

Randomised contraction: in each round every node moves to the member of its closed neighbourhood
with the least hash under that round's salt, the edges are rewritten to the new names, and loops
and repeats go. The node count falls by a constant factor in expectation whatever the shape (chains
included), so rounds grow with the logarithm of the largest component. Only minima are gathered by
node (partial aggregation), so a hub with many edges never meets in one task; the rewriting joins
are plain equi-joins that AQE splits where a hub is skewed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, staged


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, root): one row for each node that has an edge to another node; nodes share a root
    exactly if they are connected. Null ends and loops are ignored."""
    a, b = F.col(u).cast("long"), F.col(v).cast("long")
    left = staged(edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct(), "edges")
    moves: list[DataFrame] = []
    while not left.isEmpty():
        salt = F.lit(len(moves) + 1)
        both = left.select(F.col("u").alias("node"), F.col("v").alias("to")).unionByName(left.select(F.col("v").alias("node"), F.col("u").alias("to")))
        near = both.groupBy("node").agg(F.min(F.struct(F.xxhash64("to", salt).alias("h"), F.col("to"))).alias("m"))
        own = F.struct(F.xxhash64("node", salt).alias("h"), F.col("node").alias("to"))
        move = staged(near.select("node", F.least("m", own)["to"].alias("root")), "moves")
        moves.append(move)
        x = move.select(F.col("node").alias("u"), F.col("root").alias("ru"))
        y = move.select(F.col("node").alias("v"), F.col("root").alias("rv"))
        fresh = left.join(x, "u").join(y, "v").where("ru <> rv").select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct()
        fresh = staged(fresh, "edges")
        dropped(left)
        left = fresh
    if not moves:
        return left.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out = moves[-1]
    for move in reversed(moves[:-1]):
        later = out.select(F.col("node").alias("root"), F.col("root").alias("last"))
        fresh = staged(move.join(later, "root", "left").select("node", F.coalesce("last", "root").alias("root")), "components")
        dropped(out)
        dropped(move)
        out = fresh
    dropped(left)
    return out
