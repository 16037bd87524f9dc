"""Daily aggregates of high-rate tables, and the wide daily panel that joins them.

Each sensor table is aggregated per (participant, day) before it meets the spine, so the join moves
one row a day and not the samples. Intervals are pooled by default: days of equal number in two study
intervals share their sensor rows; ``interval_aware`` keeps them apart.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daylark.functions.scalar import bmi, json_number
from daylark.sources import versions

KEYS = ("participant_id", "day_in_study")
LEAST_COVERAGE = 0.5


def _by_day(rows: DataFrame, keys, **aggregates: Column) -> DataFrame:
    return rows.groupBy(*keys).agg(*[v.alias(k) for k, v in aggregates.items()])


def hrv_daily(rows: DataFrame, keys=KEYS) -> DataFrame:
    """Heart-rate variability of windows with a value and, where told, enough coverage."""
    good = rows.where(F.col("day_in_study").isNotNull() & F.col("rmssd").isNotNull() & (F.coalesce("coverage", F.lit(1.0)) >= LEAST_COVERAGE))
    v = F.col("rmssd")
    return _by_day(
        good, keys, hrv_mean=F.avg(v), hrv_median=F.percentile(v, F.lit(0.5)), hrv_min=F.min(v), hrv_max=F.max(v), hrv_std=F.stddev_samp(v),
        hrv_lf_mean=F.avg("low_frequency"), hrv_hf_mean=F.avg("high_frequency"), hrv_samples=F.count(F.lit(1)),
    )


def sleep_daily(rows: DataFrame, keys=KEYS) -> DataFrame:
    """Sessions by the day they start; stage minutes come from a JSON summary, text that isn't JSON counts 0."""
    stage = lambda name: F.sum(F.coalesce(json_number(F.col("levels"), f"$.summary.{name}.minutes"), F.lit(0.0)))
    return _by_day(
        rows.where("day_in_study is not null"), keys,
        sleep_asleep_min=F.sum("minutes_asleep"), sleep_awake_min=F.sum("minutes_awake"), sleep_in_bed_min=F.sum("time_in_bed"),
        sleep_efficiency=F.avg("efficiency"), sleep_start=F.min("sleep_start_timestamp"), sleep_end=F.max("sleep_end_timestamp"),
        sleep_deep_min=stage("deep"), sleep_rem_min=stage("rem"), sleep_light_min=stage("light"), sleep_wake_min=stage("wake"),
        sleep_sessions=F.count(F.lit(1)),
    )


def averages_daily(rows: DataFrame, columns: Mapping[str, str], keys=KEYS) -> DataFrame:
    """Daily means: output name -> input column."""
    return _by_day(rows.where("day_in_study is not null"), keys, **{k: F.avg(v) for k, v in columns.items()})


# Output names of daily means, and the input columns they come from.
SLEEP_SCORE = {
    "sleep_score": "overall_score", "sleep_composition_score": "composition_score", "sleep_revitalization_score": "revitalization_score",
    "sleep_duration_score": "duration_score", "sleep_deep_score_min": "deep_sleep_in_minutes", "sleep_rhr": "resting_heart_rate",
    "sleep_restlessness": "restlessness",
}
RESTING = {"rhr": "value", "rhr_error": "error"}
RESPIRATORY = {
    "resp_rate_full": "full_sleep_breathing_rate", "resp_rate_deep": "deep_sleep_breathing_rate",
    "resp_rate_rem": "rem_sleep_breathing_rate", "resp_rate_light": "light_sleep_breathing_rate",
}
STRESS = {
    "stress_score": "stress_score", "stress_sleep_points": "sleep_points",
    "stress_responsiveness_points": "responsiveness_points", "stress_exertion_points": "exertion_points",
}


def glucose_daily(rows: DataFrame, keys=KEYS) -> DataFrame:
    v = F.col("glucose_value")
    return _by_day(
        rows.where(F.col("day_in_study").isNotNull() & v.isNotNull()), keys, glucose_mean=F.avg(v), glucose_min=F.min(v),
        glucose_max=F.max(v), glucose_std=F.stddev_samp(v), glucose_range=F.max(v) - F.min(v), glucose_samples=F.count(F.lit(1)),
    )


def wrist_daily(rows: DataFrame, keys=KEYS) -> DataFrame:
    v = F.col("temperature_diff_from_baseline")
    return _by_day(
        rows.where(F.col("day_in_study").isNotNull() & v.isNotNull()), keys, wrist_temp_overnight_mean=F.avg(v),
        wrist_temp_daily_mean=F.avg(v), wrist_temp_samples=F.count(F.lit(1)),
    )


def latest_body(rows: DataFrame) -> DataFrame:
    """Height and weight of the later survey, else of the earlier one, and the body-mass index."""
    height, weight = F.coalesce("height_2024", "height_2022"), F.coalesce("weight_2024", "weight_2022")
    return rows.select("participant_id", height.alias("height_cm"), weight.alias("weight_kg"), bmi(height, weight).alias("bmi"))


def daily_panel(spine: DataFrame, body: DataFrame | None, sides: list[DataFrame], keys=KEYS) -> DataFrame:
    """The spine with the body table and all daily sides joined to it from the left.

    The spine and each side are hash-partitioned on the same keys, so one exchange of the spine
    serves all joins. The body table has a row per participant and is joined after the sides.
    """
    panel = spine.repartition(*keys)
    for side in sides:
        panel = panel.join(side, list(keys), "left")
    return panel.join(body, "participant_id", "left") if body is not None else panel


def build_daily_features(tables: Mapping[str, DataFrame], interval_aware: bool = False) -> DataFrame:
    """The final daily panel from the study tables; absent tables leave their columns out."""
    keys = ("participant_id", "study_interval", "day_in_study") if interval_aware else KEYS
    makers = {
        "hrv_details": hrv_daily,
        "sleep": lambda t, k: sleep_daily(t.withColumn("day_in_study", F.col("sleep_start_day_in_study")), k),
        "sleep_score": lambda t, k: averages_daily(t, SLEEP_SCORE, k),
        "resting_heart_rate": lambda t, k: averages_daily(t, RESTING, k),
        "respiratory_rate_summary": lambda t, k: averages_daily(t, RESPIRATORY, k),
        "stress_score": lambda t, k: averages_daily(t, STRESS, k),
        "glucose": glucose_daily,
        "wrist_temperature": wrist_daily,
    }
    spine = tables["hormones_selfreport"]
    if "stress" in spine.columns:
        spine = spine.withColumnRenamed("stress", "self_stress")
    body = latest_body(tables["height_weight"]) if "height_weight" in tables else None
    return daily_panel(spine, body, [make(tables[k], keys) for k, make in makers.items() if k in tables], keys)


def refresh_daily_features(tables: Mapping[str, DataFrame], path: str, interval_aware: bool = False) -> DataFrame:
    """Build the panel anew as the next version of the table under ``path``, and return that version; readers of others go on."""
    number = versions.replace(build_daily_features(tables, interval_aware), path)
    return versions.read(next(iter(tables.values())).sparkSession, path, number)
