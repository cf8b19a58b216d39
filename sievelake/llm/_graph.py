"""Distributed union-find by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import cut

MAX_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an edge list (two columns of one type): rows (node, root), root the least node.

    Self-loops give a component of their own; repeated edges and edges with a NULL end are ignored; no edges give no
    rows. A round is two aggregates by node, which combine map-side, each joined back to its edges; a hub with very many
    edges is a skewed join key, which adaptive execution splits. Rounds grow with the logarithm of the longest chain,
    and a reliable checkpoint cuts the lineage each round.
    """
    a, b = F.col(edges.columns[0]), F.col(edges.columns[1])
    first = cut(edges.where(a.isNotNull() & b.isNotNull()).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    e = first.where("u <> v")
    for _ in range(MAX_ROUNDS):
        both = e.union(e.select("v", "u"))
        low = both.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
        large = both.where("v > u").join(low, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        low = large.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
        small = large.join(low, F.col("u") == F.col("w")).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()
        e = cut(small)
        # settled when each node has one edge, to a node that has none
        ends = e.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
        if ends.where("n > 1").isEmpty() and e.join(ends.select(F.col("u").alias("w")), F.col("v") == F.col("w"), "left_semi").isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    loops = first.where("u = v").select("u", "v")
    return e.union(e.select("v", "v")).union(loops).groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
