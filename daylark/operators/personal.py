"""Personal telemetry: correlations, phase summaries, anomalies, insights, baselines, export."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daylark.functions.scalar import PHASES, half_up, sleep_minutes

PUBLIC_PHASES = ("Menstrual", "Follicular", "Ovulatory", "Luteal")


def pearson(a: Column, b: Column, digits: int = 3) -> Column:
    """Correlation over complete pairs from sums; 0 for fewer than two pairs or no variance."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    n = F.count(x)
    cov = F.sum(x * y) - F.sum(x) * F.sum(y) / F.nullif(n, F.lit(0))
    vx = F.sum(x * x) - F.sum(x) * F.sum(x) / F.nullif(n, F.lit(0))
    vy = F.sum(y * y) - F.sum(y) * F.sum(y) / F.nullif(n, F.lit(0))
    usable = (n >= 2) & (vx > 1e-9) & (vy > 1e-9)
    safe = F.when(usable, vx * vy)
    return F.coalesce(half_up(cov / F.sqrt(safe), digits), F.lit(0.0))


def phase_means(rows: DataFrame, columns: Sequence[str], phases: Sequence[str] = PUBLIC_PHASES, digits: int = 2) -> DataFrame:
    """Mean of each column per phase, 0 for phases without values."""
    grid = rows.sparkSession.range(1).select(F.explode(F.array(*[F.lit(p) for p in phases])).alias("phase"))
    means = rows.groupBy("phase").agg(*[F.avg(c).alias(c) for c in columns], F.count(F.lit(1)).alias("n"))
    full = grid.join(F.broadcast(means), "phase", "left")
    return full.select("phase", F.coalesce("n", F.lit(0)).alias("n"), *[half_up(F.coalesce(c, F.lit(0.0)), digits).alias(c) for c in columns])


def phase_summary(rows: DataFrame, digits: int = 2) -> DataFrame:
    """Per phase: days, mean mood over days that have one, sleep quality over all days, temperature over its days."""
    n = F.count(F.lit(1))
    return rows.groupBy("phase").agg(
        n.alias("days"),
        F.count("mood").alias("mood_days"),
        half_up(F.avg("mood"), digits).alias("mood"),
        half_up(F.sum(F.coalesce("sleep_quality", F.lit(0.0))) / n, digits).alias("sleep_quality"),
        F.count("temperature").alias("temperature_days"),
        half_up(F.avg("temperature"), digits).alias("temperature"),
    )


def symptom_frequency(rows: DataFrame, symptoms: Sequence[str], above: float = 2.0) -> DataFrame:
    """Days with a severity above the bound, and mean severity, per symptom."""
    long = rows.unpivot([], list(symptoms), "symptom", "severity")
    return long.groupBy("symptom").agg(F.count_if(F.col("severity") > above).alias("frequency"), F.avg("severity").alias("mean_severity"))


def anomalies(rows: DataFrame, person: str, measures: Sequence[str], total: Column, bound: float = 1.5, most: float = 25.0) -> DataFrame:
    """Rows off a person's own mean by over ``bound`` deviations, or with a symptom total above ``most``, with reasons."""
    whole = Window.partitionBy(person)
    scores = {}
    for m in measures:
        std = F.stddev_pop(m).over(whole)
        scores[f"z_{m}"] = (F.col(m) - F.avg(m).over(whole)) / F.when(std > 1e-9, std).otherwise(F.lit(1.0))
    scored = rows.withColumns(scores).withColumn("symptom_total", total)
    reasons = [F.when(F.abs(F.col(f"z_{m}")) > bound, F.lit(m)) for m in measures] + [F.when(F.col("symptom_total") > most, F.lit("symptoms"))]
    return scored.withColumn("reasons", F.concat_ws(";", *reasons)).where("reasons <> ''")


def stream_completeness(samples: DataFrame, people: DataFrame, days: int = 30) -> DataFrame:
    """Per person and stream: days with a sample among the last ``days`` of the study, and the share of them."""
    last = samples.agg(F.max("day_in_study").alias("last_day"))
    recent = samples.join(F.broadcast(last)).where(F.col("day_in_study") > F.col("last_day") - days)
    counts = recent.groupBy("participant_id", "stream").agg(F.countDistinct("day_in_study").alias("present"), F.max("day_in_study").alias("last_sample"))
    return counts.withColumns({"missing": F.lit(days) - F.col("present"), "completeness": F.col("present") / F.lit(float(days))})


def presence_heatmap(samples: DataFrame, streams: Sequence[str]) -> DataFrame:
    """Days by streams: how many participants have a sample."""
    return samples.groupBy("day_in_study").agg(*[F.countDistinct(F.when(F.col("stream") == s, F.col("participant_id"))).alias(s) for s in streams])


def insights(rows: DataFrame, person: str, most: int = 3) -> DataFrame:
    """Rule-based findings per person, at most three, a stable one where none holds.

    Luteal against follicular days: sleep lower by 0.7 or mood apart by 1.2, with two days of each;
    or a marker's mean below 0.9 of its low bound or above 1.1 of its high one.
    """
    # The thresholds of the rules, as in the docstring.
    lut, fol = F.col("phase") == "Luteal", F.col("phase") == "Follicular"
    out = rows.groupBy(person).agg(
        F.count_if(lut).alias("n_luteal"), F.count_if(fol).alias("n_follicular"),
        (F.avg(F.when(lut, F.col("sleep_quality"))) - F.avg(F.when(fol, F.col("sleep_quality")))).alias("sleep_gap"),
        (F.avg(F.when(fol, F.col("mood"))) - F.avg(F.when(lut, F.col("mood")))).alias("mood_gap"),
        F.avg("marker").alias("marker"), F.first("low").alias("low"), F.first("high").alias("high"),
    )
    enough = (F.col("n_luteal") >= 2) & (F.col("n_follicular") >= 2)
    found = F.array_compact(F.array(
        F.when(enough & (F.col("sleep_gap") < -0.7), F.lit("sleep_drop")),
        F.when(enough & (F.col("mood_gap") > 1.2), F.lit("mood_shift")),
        F.when(F.col("marker") < 0.9 * F.col("low"), F.lit("marker_low")).when(F.col("marker") > 1.1 * F.col("high"), F.lit("marker_high")),
    ))
    return out.select(person, F.concat_ws(";", F.when(F.size(found) == 0, F.array(F.lit("stable"))).otherwise(F.slice(found, 1, most))).alias("insights"))


def export_packet(rows: DataFrame, alias: Column, opted_in: Column, strict: bool) -> DataFrame:
    """Shared records: only of people who opted in; strict packets blunt dates to months and drop notes."""
    shared = rows.where(opted_in).withColumn("alias", F.coalesce(F.nullif(alias, F.lit("")), F.lit("anonymous")))
    if strict:
        shared = shared.withColumns({"date": F.trunc("date", "MM"), "notes": F.lit("")})
    return shared


def export_bundle(shared: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One JSON document per alias: an envelope with its records in order of dates."""
    records = F.sort_array(F.collect_list(F.struct(*columns)))
    return shared.groupBy("alias").agg(F.to_json(F.struct(F.lit(1).alias("version"), F.count(F.lit(1)).alias("count"), records.alias("records"))).alias("bundle"))


def envelopes(rows: DataFrame, person: str, alias: Column, opted_in: Column) -> DataFrame:
    """Per person the alias, the consent and the number of shared records; without consent "OPTED-OUT" and none."""
    known = rows.select(F.col(person), alias.alias("__alias"), F.coalesce(opted_in, F.lit(False)).alias("__in"))
    out = known.groupBy(person).agg(F.max("__alias").alias("__alias"), F.bool_and("__in").alias("consent"), F.count_if("__in").alias("records"))
    return out.select(
        person, F.when(F.col("consent"), F.col("__alias")).otherwise("OPTED-OUT").alias("alias"), "consent", F.when(F.col("consent"), F.col("records")).otherwise(0).alias("records")
    )


# What entries must lie within, both ends included; nulls pass.
LIMITS = {"cycle_day": (1, 60), "temperature": (34, 40), "cycle_length": (20, 45), "luteal_length": (8, 18)}


def validated(rows: DataFrame) -> DataFrame:
    """``rows`` with a boolean ``<column>_ok`` for each limited column."""
    return rows.withColumns({f"{c}_ok": F.coalesce(F.col(c).between(*ends), F.lit(True)) for c, ends in LIMITS.items()})


# The dashboard's names of features.
DASHBOARD_NAMES = {
    "bmi": "bmi", "wristTempDelta": "wrist_temp_overnight_mean", "lh": "lh", "estradiol": "estrogen", "hrv": "hrv_mean",
    "respiratoryRate": "resp_rate_full", "sleepScore": "sleep_score", "sleepDuration": "sleep_asleep_min", "stressScore": "stress_score",
    "glucose": "glucose_mean", "cramps": "cramps", "bloating": "bloating",
}


def to_features(rows: DataFrame) -> DataFrame:
    """Dashboard columns under their feature names; sleep in hours becomes minutes."""
    if "sleepDuration" in rows.columns:
        rows = rows.withColumn("sleepDuration", sleep_minutes(F.col("sleepDuration")))
    return rows.withColumnsRenamed({k: v for k, v in DASHBOARD_NAMES.items() if k in rows.columns})


# The features of a day in their order, and the columns that are none of a model's inputs.
FEATURE_KEYS = (
    "phase", "lh", "estrogen", "pdg", "height_cm", "weight_kg", "bmi",
    "hrv_mean", "hrv_median", "hrv_min", "hrv_max", "hrv_std", "hrv_lf_mean", "hrv_hf_mean", "hrv_samples",
    "sleep_asleep_min", "sleep_in_bed_min", "sleep_awake_min", "sleep_efficiency", "sleep_deep_min", "sleep_rem_min", "sleep_light_min",
    "sleep_wake_min", "sleep_start", "sleep_end", "sleep_sessions",
    "sleep_score", "sleep_composition_score", "sleep_revitalization_score", "sleep_duration_score", "sleep_deep_score_min", "sleep_rhr",
    "sleep_restlessness", "rhr", "rhr_error", "resp_rate_full", "resp_rate_deep", "resp_rate_rem", "resp_rate_light",
    "stress_score", "stress_sleep_points", "stress_responsiveness_points", "stress_exertion_points",
    "glucose_mean", "glucose_min", "glucose_max", "glucose_std", "glucose_range", "glucose_samples", "wrist_temp_overnight_mean",
    "cramps", "bloating", "fatigue", "headaches", "sorebreasts", "moodswing", "self_stress", "sleepissue",
)
NOT_PREDICTORS = ("phase", "participant_id", "day_in_study", "sleep_start", "sleep_end")


def predictors(columns: Sequence[str] = FEATURE_KEYS) -> list[str]:
    return [c for c in columns if c not in NOT_PREDICTORS]


def phase_logits(day: Column, skin_delta: Column, hrv: Column) -> list[Column]:
    """Heuristic logits of the four public phases by cycle day, skin temperature and heart-rate variability."""
    day = F.coalesce(day, F.lit(14))
    # Logits per phase and the bounds that choose them.
    return [
        F.when(day <= 5, F.lit(2.5)).otherwise(F.lit(-1.0)),
        F.when((day > 5) & (day < 13), F.lit(2.0)).otherwise(F.lit(-0.5)) + F.when(hrv > 55, F.lit(0.4)).otherwise(F.lit(0.0)),
        F.when((day >= 13) & (day <= 16), F.lit(2.8)).otherwise(F.lit(-1.0)),
        F.when(day > 16, F.lit(2.2)).otherwise(F.lit(-1.0)) + F.when(skin_delta > 0.2, F.lit(0.6)).otherwise(F.lit(0.0)),
    ]


__all__ = [
    "PHASES", "PUBLIC_PHASES", "anomalies", "export_bundle", "export_packet", "insights", "pearson", "phase_logits", "phase_means",
    "phase_summary", "presence_heatmap", "stream_completeness", "symptom_frequency",
]
