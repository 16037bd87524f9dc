"""Connected components of an edge table by alternating large-star and small-star steps.

Defined cases: an empty table gives an empty result; edges with a null end and self-loops are dropped,
repeated edges count once. The root is the smallest node, so there are no ties.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daylark.llm.common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.withColumnRenamed("m", "b")).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for each node of the edges ``(a, b)``; the root is the component's smallest node.

    Each round is written to the shared folder, so that lineage stays short and lost executors only
    cost the running round. Self-loops and repeated edges are allowed; null ends are dropped.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = stored(now, "edges")
    before = None
    for _ in range(most_rounds):
        if before == (state := _state(now)):
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        before = state
        now = stored(_small_star(_large_star(now)), "edges")
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
