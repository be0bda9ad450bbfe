"""Connected groups of a graph by contraction, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.session import lookup_side, settle


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)``; nodes share a root if edges join them.

    Each round every node picks the neighbour (or itself) of the smallest hash, edges move to the
    picked nodes, and edges within one node vanish. Hashes are drawn anew each round, so chains
    shrink by a constant factor whatever their order. Picks are combined before the shuffle, and
    what a popular node attracts is a join that Spark may split. Written rows cut the lineage.
    """
    open_edges = settle(
        edges.where(F.col("a") != F.col("b"))
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )
    found = None
    step = 0
    while not open_edges.isEmpty():
        both = open_edges.unionByName(open_edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        order = lambda name, seed=step: F.struct(F.xxhash64(F.col(name), F.lit(seed)).alias("h"), F.col(name).alias("n"))
        picked = lookup_side(
            both.groupBy("a")
            .agg(F.min(order("b")).alias("best"))
            .select(F.col("a").alias("node"), F.least(F.col("best"), order("a"))["n"].alias("pick"))
        )
        if found is None:
            found = picked.select("node", F.col("pick").alias("root"))
        else:
            moved = picked.select(F.col("node").alias("was"), "pick")
            found = settle(
                found.join(moved, F.col("root") == F.col("was"), "left").select(
                    "node", F.coalesce("pick", "root").alias("root")
                )
            )
        a = picked.select(F.col("node").alias("na"), F.col("pick").alias("pa"))
        b = picked.select(F.col("node").alias("nb"), F.col("pick").alias("pb"))
        open_edges = settle(
            open_edges.join(a, F.col("a") == F.col("na"))
            .join(b, F.col("b") == F.col("nb"))
            .where(F.col("pa") != F.col("pb"))
            .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
            .distinct()
        )
        step += 1
    if found is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).where(F.lit(False))
    return found
