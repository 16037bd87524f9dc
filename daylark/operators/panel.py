"""Sequence operators on daily panels: rolling values, bands, tails, week over week, forecasts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daylark.functions.scalar import PHASES, half_up
from daylark.operators.profile import guarded_std

PERSON, DAY = "participant_id", "day_in_study"


def rolling_last_observed(panel: DataFrame, value: str, window: int = 7, person: str = PERSON, day: str = DAY) -> DataFrame:
    """Mean and sample deviation of the last ``window`` non-null values up to each day; 0 deviation for one value.

    Days without a value carry the values before them. The observations alone are ranked, framed by
    rows, and carried forward, so no list of a participant's past is built.
    """
    by_day = Window.partitionBy(person).orderBy(day)
    frame = by_day.rowsBetween(-(window - 1), 0)
    seen = panel.where(F.col(value).isNotNull()).select(
        person, day, F.avg(value).over(frame).alias("mean"),
        F.when(F.count(value).over(frame) > 1, F.stddev_samp(value).over(frame)).otherwise(F.lit(0.0)).alias("std"),
    )
    carried = by_day.rowsBetween(Window.unboundedPreceding, 0)
    joined = panel.join(seen, [person, day], "left")
    last = lambda c: F.last(c, ignorenulls=True).over(carried)
    return joined.withColumns({"mean": last("mean"), "std": last("std")})


def rolling_rows(panel: DataFrame, value: str, window: int, digits: int = 2, person: str = PERSON, day: str = DAY) -> DataFrame:
    """Mean over the last ``window`` rows, nulls among them skipped."""
    frame = Window.partitionBy(person).orderBy(day).rowsBetween(-(window - 1), 0)
    return panel.withColumn("rolling", half_up(F.avg(value).over(frame), digits))


def participant_zscore(panel: DataFrame, train: Column, value: str, person: str = PERSON) -> DataFrame:
    """z-scores by each participant's training rows; unseen ones and flat ones use all training rows."""
    known = panel.where(train & F.col(value).isNotNull())
    own = known.groupBy(person).agg(F.avg(value).alias("own_mean"), F.nullif(F.stddev_pop(value), F.lit(0.0)).alias("own_std"))
    whole = known.agg(F.avg(value).alias("all_mean"), guarded_std(F.col(value), population=True).alias("all_std"))
    joined = panel.join(own, person, "left").join(F.broadcast(whole))
    mean, std = F.coalesce("own_mean", "all_mean"), F.coalesce("own_std", "all_std")
    return joined.withColumn("z", (F.col(value) - mean) / std).drop("own_mean", "own_std", "all_mean", "all_std")


def bands(panel: DataFrame, label: str, person: str = PERSON, day: str = DAY) -> DataFrame:
    """Runs of equal labels: first and last day and length."""
    by_day = Window.partitionBy(person).orderBy(day)
    change = F.coalesce((F.lag(label).over(by_day) != F.col(label)).cast("int"), F.lit(1))
    run = F.sum("__change").over(by_day.rowsBetween(Window.unboundedPreceding, 0))
    runs = panel.withColumn("__change", change).withColumn("band", run)
    return runs.groupBy(person, "band", label).agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.count(F.lit(1)).alias("days"))


def tail(panel: DataFrame, n: int, by: Sequence[str] = (PERSON,), order: Sequence[Column] | None = None) -> DataFrame:
    """The last ``n`` rows per group."""
    window = Window.partitionBy(*by).orderBy(*(order or [F.desc(DAY)]))
    return panel.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= n)


def latest_observed(rows: DataFrame, by: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """The last non-null value per group, by a total order; two-phase aggregation, no sort."""
    present = rows.where(F.col(value).isNotNull())
    return present.groupBy(*by).agg(F.max(F.struct(*order, value)).alias("__last")).select(*by, "__last.*")


def week_over_week(panel: DataFrame, value: str, days: int = 7, person: str = PERSON, day: str = DAY) -> DataFrame:
    """Means of the last ``days`` rows and of as many before them, and their difference."""
    ranked = tail(panel, 2 * days, [person], [F.desc(day)])
    recent, before = F.col("rank") <= days, F.col("rank") > days
    out = ranked.groupBy(person).agg(F.avg(F.when(recent, F.col(value))).alias("recent"), F.avg(F.when(before, F.col(value))).alias("previous"))
    return out.withColumn("change", F.col("recent") - F.col("previous"))


def week_cards(rows: DataFrame, digits: dict[str, int], days: int = 7, person: str = PERSON, day: str = DAY) -> DataFrame:
    """Per participant the mean of each column over the last ``days`` rows, rounded to the column's digits."""
    order = Window.partitionBy(person).orderBy(F.desc(day))
    last = rows.withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") <= days)
    return last.groupBy(person).agg(*[half_up(F.avg(c), n).alias(c) for c, n in digits.items()])


def forecast(latest: DataFrame, days: int = 14, person: str = PERSON) -> DataFrame:
    """Cycle days ahead of each participant's last one, with a sine and a linear guess of the day's level."""
    ahead = latest.withColumn("ahead", F.explode(F.sequence(F.lit(1), F.lit(days))))
    day = F.pmod(F.col("cycle_day") + F.col("ahead") - 1, F.col("cycle_length")) + 1
    part = day / F.col("cycle_length")
    return ahead.select(
        person, "ahead", day.alias("cycle_day"), F.sin(2 * 3.141592653589793 * part).alias("wave"), (1 - part).alias("line")
    )


def sequences(panel: DataFrame, columns: Sequence[str], person: str = PERSON, day: str = DAY) -> DataFrame:
    """Each participant's rows as one array in order of days."""
    return panel.groupBy(person).agg(F.sort_array(F.collect_list(F.struct(day, *columns))).alias("rows"))


def transition_matrix(panel: DataFrame, label: str = "phase", person: str = PERSON, day: str = DAY) -> DataFrame:
    """Add-one smoothed shares of the next day's label given the day's, over all pairs of labels."""
    pairs = panel.withColumn("to", F.lead(label).over(Window.partitionBy(person).orderBy(day))).where("to is not null")
    counts = pairs.groupBy(F.col(label).alias("from"), "to").agg(F.count(F.lit(1)).alias("n"))
    labels = F.array(*[F.lit(p) for p in PHASES])
    grid = panel.sparkSession.range(1).select(F.explode(labels).alias("from")).withColumn("to", F.explode(labels))
    full = grid.join(F.broadcast(counts), ["from", "to"], "left").na.fill(0, ["n"])
    total = F.sum(F.col("n") + 1).over(Window.partitionBy("from"))
    return full.select("from", "to", "n", ((F.col("n") + 1) / total).alias("probability"))


def prior(panel: DataFrame, label: str = "phase") -> DataFrame:
    """Add-one smoothed shares of the labels."""
    counts = panel.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    grid = panel.sparkSession.range(1).select(F.explode(F.array(*[F.lit(p) for p in PHASES])).alias(label))
    full = grid.join(F.broadcast(counts), label, "left").na.fill(0, ["n"])
    total = F.sum(F.col("n") + 1).over(Window.partitionBy(F.lit(1)))
    return full.select(label, "n", ((F.col("n") + 1) / total).alias("probability"))
