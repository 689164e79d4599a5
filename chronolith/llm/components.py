"""Connected components by repeated contraction; nothing of the graph comes to the driver but counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of longs to ``(node, component_id)``, the least node that can be reached; isolated nodes don't appear.

    Each round sends a node to its least neighbour (least by id at first, so that
    stars fall together at once, then by a hash of the round, so that chains
    shrink by a constant factor) and contracts the edges.  Self-loops, repeated
    and null edges are dropped.
    """
    edges = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = materialize(edges, "edges")
    maps: list[DataFrame] = []
    while not edges.isEmpty():
        k = len(maps)
        both = edges.union(edges.select("b", "a"))
        rank = F.lit(0).cast("long") if k < 2 else F.xxhash64("n", F.lit(k))
        near = both.select(F.col("a").alias("node"), F.col("b").alias("n")).union(edges.selectExpr("a AS node", "a AS n")).union(edges.selectExpr("b AS node", "b AS n"))
        to = near.groupBy("node").agg(F.min(F.struct(rank.alias("r"), F.col("n"))).alias("m")).select("node", F.col("m.n").alias("to"))
        to = materialize(to, "contract")
        maps.append(to)
        pa, pb = (to.select(F.col("node").alias(c), F.col("to").alias(f"t{c}")) for c in "ab")
        edges = (
            edges.join(pa, "a").join(pb, "b").where("ta <> tb")
            .select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct()
        )
        edges = materialize(edges, "edges")
    if not maps:
        return edges.selectExpr("a AS node", "b AS component_id")
    root = maps[-1].select("node", F.col("to").alias("root"))
    for to in reversed(maps[:-1]):
        step = to.alias("s").join(root.withColumnRenamed("node", "to"), "to", "left").select("node", F.coalesce("root", "to").alias("root"))
        root = step
    root = materialize(root, "roots")
    least = root.groupBy("root").agg(F.min("node").alias("component_id"))
    return root.join(least, "root").select("node", F.least("component_id", "root").alias("component_id"))
