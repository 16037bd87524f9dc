"""Stratified splits and folds of participants by a hash order, without leakage of a participant's rows.

A participant's place in its stratum is its rank by the MD5 of the seed and its id. Ranks are exact but need no sort of
a whole stratum in one task: each stratum is cut into hash ranges, ranked within, and offset by the
sizes of the ranges before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SEED = 42
TEST_SHARE = VAL_SHARE = 0.15


def hash_rank(people: DataFrame, person: str, stratum: str, seed: int = SEED) -> DataFrame:
    """``people`` with ``rank`` (0-based) within its stratum by hash, and ``size`` of the stratum."""
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(person).cast("string")))
    cut = people.withColumns({"__order": order, "__range": F.substring(order, 1, 2)})
    sizes = cut.groupBy(stratum, "__range").agg(F.count(F.lit(1)).alias("__n"))
    by_range = Window.partitionBy(stratum).orderBy("__range")
    offsets = sizes.select(
        stratum, "__range", (F.sum("__n").over(by_range) - F.col("__n")).alias("__before"), F.sum("__n").over(Window.partitionBy(stratum)).alias("size")
    )
    within = F.row_number().over(Window.partitionBy(stratum, "__range").orderBy("__order", person)) - 1
    ranked = cut.withColumn("__within", within).join(F.broadcast(offsets), [stratum, "__range"])  # at most 256 rows a stratum
    return ranked.withColumn("rank", F.col("__before") + F.col("__within")).drop("__order", "__range", "__before", "__within")


def stratified_split(people: DataFrame, person: str, stratum: str, seed: int = SEED) -> DataFrame:
    """train / val / test: of each stratum of n, round(0.15 n) go to test and as many to validation."""
    part = lambda share: F.floor(F.col("size") * F.lit(share) + 0.5)
    split = F.when(F.col("rank") < part(TEST_SHARE), "test").when(F.col("rank") < part(TEST_SHARE) + part(VAL_SHARE), "val").otherwise("train")
    return hash_rank(people, person, stratum, seed).select(person, stratum, split.alias("split"))


def stratified_folds(people: DataFrame, person: str, stratum: str, k: int = 5, seed: int = SEED) -> DataFrame:
    """Round robin over folds in each stratum, every stratum starting at fold 0."""
    return hash_rank(people, person, stratum, seed).select(person, stratum, (F.col("rank") % k).cast("int").alias("fold"))
