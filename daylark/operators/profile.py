"""Coverage, missingness, class balance, robust statistics and their tie rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from daylark.functions.scalar import PHASES


def unpivoted(rows: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str = "feature", value: str = "value") -> DataFrame:
    return rows.unpivot(list(ids), list(columns), name, value)


def feature_coverage(panel: DataFrame, features: Sequence[str]) -> DataFrame:
    """Per feature the number of values and their share of all rows (0 for an empty panel), in one scan."""
    counts = panel.agg(F.count(F.lit(1)).alias("__n"), *[F.count(c).alias(c) for c in features])
    share = F.when(F.col("__n") > 0, F.col("non_null") / F.col("__n")).otherwise(F.lit(0.0))
    return counts.unpivot(["__n"], list(features), "feature", "non_null").select("feature", "non_null", share.alias("completeness"))


def table_overview(tables: dict[str, tuple[DataFrame, bool]], person: str = "participant_id", day: str = "day_in_study") -> DataFrame:
    """Rows, participants and span of days per table; tables without days (flag False) have null spans."""
    out = None
    for name, (rows, has_days) in tables.items():
        span = [F.min(day).cast("int"), F.max(day).cast("int")] if has_days else [F.lit(None).cast("int")] * 2
        one = rows.agg(
            F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n_rows"), F.countDistinct(person).alias("participants"),
            span[0].alias("day_min"), span[1].alias("day_max"),
        )
        out = one if out is None else out.unionByName(one)
    return out


def footers(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table whose counts, and least and largest values of numbers and dates, Spark takes from file footers.

    Only Spark's second reader does so: the source list is changed while the table is looked up, and set back.
    """
    spark.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    before = spark.conf.get("spark.sql.sources.useV1SourceList")
    spark.conf.set("spark.sql.sources.useV1SourceList", "")
    try:
        return spark.read.parquet(path)
    finally:
        spark.conf.set("spark.sql.sources.useV1SourceList", before)


def footer_overview(spark: SparkSession, tables: Mapping[str, tuple[str, str | None]]) -> DataFrame:
    """(table_name, n_rows, day_min, day_max, populated) of Parquet tables by name, given as path and integer day column or None.

    No data page is read: a table of any size costs one read of its footers. ``populated`` is 1 for a table with rows. The
    row ``total`` has the sum of rows, the span over all tables and the number of populated ones. A table without rows counts 0.
    """
    every = None
    for name, (path, day) in tables.items():
        span = [F.min(day), F.max(day)] if day else []
        found = footers(spark, path).agg(F.count(F.lit(1)).alias("n"), *[x.alias(c) for x, c in zip(span, ("low", "high"))])
        ends = [F.col(c).cast("long") if day else F.lit(None).cast("long") for c in ("low", "high")]
        one = found.select(F.lit(name).alias("table_name"), "n", ends[0].alias("low"), ends[1].alias("high"))
        every = one if every is None else every.unionByName(one)
    # a table without a row group has no pushed count at all, so the sum's null is what stands for 0
    return every.rollup("table_name").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.min("low").alias("day_min"), F.max("high").alias("day_max"), F.count_if(F.col("n") > 0).alias("populated"), F.grouping("table_name").alias("__all"),
    ).select(F.when(F.col("__all") == 1, "total").otherwise(F.col("table_name")).alias("table_name"), "n_rows", "day_min", "day_max", "populated")


def missingness(panel: DataFrame, by: str, features: Sequence[str]) -> DataFrame:
    """Share of nulls per group and feature."""
    shares = panel.groupBy(by).agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in features])
    return unpivoted(shares, [by], features, "feature", "missing")


def phase_counts(panel: DataFrame, person: str = "participant_id", phase: str = "phase") -> DataFrame:
    """Days per participant and phase as columns, and their total."""
    wide = panel.where(F.col(phase).isin(*PHASES)).groupBy(person).pivot(phase, list(PHASES)).count().na.fill(0)
    return wide.withColumn("total", sum((F.col(p) for p in PHASES[1:]), F.col(PHASES[0])))


def dominant_phase(counts: DataFrame) -> DataFrame:
    """The phase with most days; on ties the first in class order."""
    top = F.greatest(*PHASES)
    choice = F.lit(None).cast("string")
    for name in reversed(PHASES):
        choice = F.when(F.col(name) == top, F.lit(name)).otherwise(choice)
    return counts.withColumn("dominant", choice)


def class_shares(panel: DataFrame, by: str, phase: str = "phase") -> DataFrame:
    """Days and share per group and phase, also for phases without days."""
    grid = panel.select(by).distinct().withColumn(phase, F.explode(F.array(*[F.lit(p) for p in PHASES])))
    counts = panel.where(F.col(phase).isin(*PHASES)).groupBy(by, phase).agg(F.count(F.lit(1)).alias("n"))
    full = grid.join(counts, [by, phase], "left").na.fill(0, ["n"])
    total = F.sum("n").over(Window.partitionBy(by))
    return full.withColumn("share", F.when(total > 0, F.col("n") / total).otherwise(F.lit(0.0)))


def class_weights(panel: DataFrame, phase: str = "phase") -> DataFrame:
    """N / (K * n) per class, 1 for absent ones."""
    counts = panel.groupBy(phase).agg(F.count(F.lit(1)).alias("n"))
    classes = panel.sparkSession.createDataFrame([(p,) for p in PHASES], f"{phase} string")
    full = classes.join(counts, phase, "left").na.fill(0, ["n"])
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    return full.withColumn("weight", F.when(F.col("n") > 0, total / (F.lit(float(len(PHASES))) * F.col("n"))).otherwise(F.lit(1.0)))


#: Ranges that the values of a group are cut into before they are sorted, and how many of its values the cuts are taken from, about.
RANGES, CUT_FROM = 64, 4096


def counted(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(by, __v, __n): how often each non-null value of a group occurs."""
    return rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))


def values_at(rows: DataFrame, by: Sequence[str], value: str, wanted: DataFrame) -> DataFrame:
    """``wanted`` (by, rank: 0-based places among a group's non-null values in order) with the value at each place.

    Exact, and without a group in one task: equal values are counted first, cut into ``RANGES`` at the
    quantiles of some of them, sorted within a range, and offset by the sizes of the ranges before.
    """
    return _placed(counted(rows, by, value), by, value, wanted)


def range_edges(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, __edges): where a group's values are cut into ranges, the quantiles of those that a hash chooses.

    A plan may work the edges out more than once, from rows that arrive in any order, and ranges must be the same each time: a
    sketch of quantiles is not. All values are chosen where they are few, so that only a long group may (hardly) get no edges.
    """
    some = counts.where("__n > 0")
    share = F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / F.lit(float(CUT_FROM)))).alias("__share")
    chosen = some.join(some.groupBy(*by).agg(share), list(by)).where(F.pmod(F.xxhash64("__v"), F.col("__share")) == 0)
    return chosen.groupBy(*by).agg(F.percentile("__v", F.array(*[F.lit(k / RANGES) for k in range(1, RANGES)])).alias("__edges"))


def _placed(counts: DataFrame, by: Sequence[str], value: str, wanted: DataFrame) -> DataFrame:
    """``values_at`` of what ``counted`` gives. All branches use its counts, so that its one shuffle is shared by them."""
    below = F.size(F.filter(F.coalesce("__edges", F.array().cast("array<double>")), lambda e: e < F.col("__v")))
    cut = counts.join(range_edges(counts, by), list(by), "left").withColumn("__range", below).drop("__edges")
    before = Window.partitionBy(*by).orderBy("__range")
    sizes = cut.groupBy(*by, "__range").agg(F.sum("__n").alias("__size"))
    sizes = sizes.select(*by, "__range", (F.sum("__size").over(before) - F.col("__size")).alias("__before"))
    upto = F.col("__before") + F.sum("__n").over(Window.partitionBy(*by, "__range").orderBy("__v"))
    placed = cut.join(sizes, [*by, "__range"]).withColumn("__upto", upto)
    hit = (F.col("rank") < F.col("__upto")) & (F.col("rank") >= F.col("__upto") - F.col("__n"))
    return wanted.join(placed, list(by)).where(hit).select(*by, "rank", F.col("__v").alias(value))


def medians(rows: DataFrame, columns: Sequence[str], empty: float | None = None) -> DataFrame:
    """Exact medians in one row; ``empty`` stands for columns without values."""
    long = unpivoted(rows.select(*[F.col(c).cast("double").alias(c) for c in columns]), [], columns).where("value is not null")
    counts = counted(long, ["feature"], "value")
    n = counts.groupBy("feature").agg(F.sum("__n").alias("n"))
    middle = n.select("feature", F.explode(F.array(F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2))).alias("rank"))
    found = _placed(counts, ["feature"], "value", middle).groupBy().pivot("feature", list(columns)).agg(F.avg("value"))
    return found.select(*[(F.col(c) if empty is None else F.coalesce(c, F.lit(float(empty)))).alias(c) for c in columns])


def first_mode(rows: DataFrame, by: Sequence[str], value: str, order: str) -> DataFrame:
    """The most frequent value per group; on ties the one that comes first by ``order``."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first_seen"))
    window = Window.partitionBy(*by).orderBy(F.desc("n"), "first_seen", value)
    return counts.withColumn("__rank", F.row_number().over(window)).where("__rank = 1").drop("__rank")


def guarded_std(value: Column, population: bool = False) -> Column:
    """Standard deviation; 1 where it has no meaning (one row, or next to no spread)."""
    spread = F.stddev_pop(value) if population else F.stddev_samp(value)
    none = spread == 0 if population else (F.count(value) < 2) | (spread <= 1e-9)
    return F.when(none | spread.isNull(), F.lit(1.0)).otherwise(spread)


def quantile_thresholds(rows: DataFrame, by: Sequence[str], value: str, k: int) -> DataFrame:
    """Candidate cuts at floor(i / (k + 1) * n) of the sorted values, repeats of the one before dropped."""
    counts = counted(rows, by, value)
    sizes = counts.groupBy(*by).agg(F.sum("__n").alias("n"))
    wanted = sizes.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(k))))
    wanted = wanted.withColumn("rank", F.floor(F.col("i") / F.lit(float(k + 1)) * F.col("n"))).drop("n")
    found = _placed(counts, by, value, wanted.select(*by, "rank").distinct()).join(wanted, [*by, "rank"]).withColumnRenamed(value, "threshold")
    before = F.lag("threshold").over(Window.partitionBy(*by).orderBy("i"))
    return found.withColumn("__before", before).where("__before is null or __before <> threshold").select(*by, "i", "threshold")


def missingness_change(before: DataFrame, after: DataFrame, by: str, features: Sequence[str]) -> DataFrame:
    """Per group the share of nulls of each feature before and after, and the mean over the features in percent."""
    def shares(rows: DataFrame, end: str) -> DataFrame:
        own = [F.avg(F.col(c).isNull().cast("double")) for c in features]
        mean = 100.0 * sum(own[1:], own[0]) / len(features)
        return rows.groupBy(by).agg(*[x.alias(f"{c}_{end}") for x, c in zip(own, features)], mean.alias(f"mean_{end}"))

    return shares(before, "before").join(shares(after, "after"), by)


def with_metadata(specs: DataFrame, known: DataFrame, key: str, defaults: dict) -> DataFrame:
    """Definitions with what is known of each, ``defaults`` where nothing is."""
    return specs.join(known, key, "left").na.fill(defaults)
