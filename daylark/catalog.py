"""Catalog of study tables: key style, merge keys, CSV columns with their coercion, which are required."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StringType, StructField, StructType

TYPES = {"string": StringType(), "json": StringType(), "number": DoubleType(), "int": IntegerType(), "bool": BooleanType()}


@dataclass(frozen=True)
class Field:
    header: str
    column: str
    kind: str
    required: bool = False


@dataclass(frozen=True)
class Table:
    key: str
    category: str
    key_style: str  #: day, day_ts, window, session or participant
    merge_keys: tuple[str, ...] = ()
    fields: tuple[Field, ...] = field(default=())
    active: bool = True

    @property
    def has_days(self) -> bool:
        return self.key_style in ("day", "day_ts")

    def schema(self) -> StructType:
        return StructType([StructField(f.column, TYPES[f.kind], not f.required) for f in self.fields])

    def raw_schema(self) -> StructType:
        return StructType([StructField(f.header, StringType()) for f in self.fields])


_DAY = (
    Field("id", "participant_id", "int", True),
    Field("study_interval", "study_interval", "int", True),
    Field("is_weekend", "is_weekend", "bool"),
    Field("day_in_study", "day_in_study", "int", True),
)
_DAY_KEYS = ("participant_id", "study_interval", "day_in_study")

# The tables' CSV headers, columns, coercions (the last value says whether required) and keys.
TABLES = {t.key: t for t in (
    Table("sleep_score", "sleep", "day", _DAY_KEYS, (
        *_DAY,
        Field("timestamp", "timestamp_local", "string"),
        Field("overall_score", "overall_score", "number"),
        Field("composition_score", "composition_score", "number"),
        Field("revitalization_score", "revitalization_score", "number"),
        Field("duration_score", "duration_score", "number"),
        Field("deep_sleep_in_minutes", "deep_sleep_in_minutes", "number"),
        Field("resting_heart_rate", "resting_heart_rate", "number"),
        Field("restlessness", "restlessness", "number"),
    )),
    Table("sleep", "sleep", "session", ("participant_id", "study_interval", "sleep_start_day_in_study", "sleep_start_timestamp"), (
        Field("id", "participant_id", "int", True),
        Field("study_interval", "study_interval", "int", True),
        Field("is_weekend", "is_weekend", "bool"),
        Field("sleep_start_day_in_study", "sleep_start_day_in_study", "int", True),
        Field("sleep_start_timestamp", "sleep_start_timestamp", "string", True),
        Field("sleep_end_day_in_study", "sleep_end_day_in_study", "int"),
        Field("sleep_end_timestamp", "sleep_end_timestamp", "string"),
        Field("duration", "duration", "number"),
        Field("minutestofallasleep", "minutes_to_fall_asleep", "number"),
        Field("minutesasleep", "minutes_asleep", "number"),
        Field("minutesawake", "minutes_awake", "number"),
        Field("minutesafterwakeup", "minutes_after_wakeup", "number"),
        Field("timeinbed", "time_in_bed", "number"),
        Field("efficiency", "efficiency", "number"),
        Field("levels", "levels", "json"),
    )),
    Table("hrv_details", "cardio", "window", (*_DAY_KEYS, "timestamp_local"), (
        *_DAY,
        Field("timestamp", "timestamp_local", "string", True),
        Field("rmssd", "rmssd", "number"),
        Field("coverage", "coverage", "number"),
        Field("low_frequency", "low_frequency", "number"),
        Field("high_frequency", "high_frequency", "number"),
    )),
    Table("resting_heart_rate", "cardio", "day", _DAY_KEYS, (
        *_DAY,
        Field("value", "value", "number"),
        Field("error", "error", "number"),
    )),
    Table("wrist_temperature", "temperature", "day_ts", _DAY_KEYS, (
        Field("id", "participant_id", "int", True),
        Field("study_interval", "study_interval", "int", True),
        Field("day_in_study", "day_in_study", "int", True),
        Field("is_weekend", "is_weekend", "bool"),
        Field("temperature_diff_from_baseline", "temperature_diff_from_baseline", "number"),
    )),
    Table("respiratory_rate_summary", "respiration", "day_ts", _DAY_KEYS, (
        *_DAY,
        Field("timestamp", "timestamp_local", "string"),
        Field("full_sleep_breathing_rate", "full_sleep_breathing_rate", "number"),
        Field("full_sleep_standard_deviation", "full_sleep_standard_deviation", "number"),
        Field("full_sleep_signal_to_noise", "full_sleep_signal_to_noise", "number"),
        Field("deep_sleep_breathing_rate", "deep_sleep_breathing_rate", "number"),
        Field("light_sleep_breathing_rate", "light_sleep_breathing_rate", "number"),
        Field("rem_sleep_breathing_rate", "rem_sleep_breathing_rate", "number"),
    )),
    Table("stress_score", "stress", "day", _DAY_KEYS, (
        *_DAY,
        Field("timestamp", "timestamp_local", "string"),
        Field("stress_score", "stress_score", "number"),
        Field("sleep_points", "sleep_points", "number"),
        Field("max_sleep_points", "max_sleep_points", "number"),
        Field("responsiveness_points", "responsiveness_points", "number"),
        Field("max_responsiveness_points", "max_responsiveness_points", "number"),
        Field("exertion_points", "exertion_points", "number"),
        Field("max_exertion_points", "max_exertion_points", "number"),
        Field("status", "status", "string"),
        Field("calculation_failed", "calculation_failed", "bool"),
    )),
    Table("hormones_selfreport", "hormones", "day", _DAY_KEYS, (
        Field("id", "participant_id", "int", True),
        Field("study_interval", "study_interval", "int", True),
        Field("day_in_study", "day_in_study", "int", True),
        Field("is_weekend", "is_weekend", "bool"),
        Field("phase", "phase", "string"),
        Field("lh", "lh", "number"),
        Field("estrogen", "estrogen", "number"),
        Field("pdg", "pdg", "number"),
    )),
    Table("height_weight", "body", "participant", ("participant_id",), (
        Field("id", "participant_id", "int", True),
        Field("height_2022", "height_2022", "number"),
        Field("weight_2022", "weight_2022", "number"),
        Field("height_2024", "height_2024", "number"),
        Field("weight_2024", "weight_2024", "number"),
    )),
    *(Table(key, category, style, active=False) for key, category, style in (
        ("heart_rate", "cardio", "day_ts"), ("steps", "activity", "day_ts"), ("distance", "activity", "day_ts"),
        ("calories", "activity", "day_ts"), ("altitude", "activity", "day_ts"), ("active_minutes", "activity", "day"),
        ("active_zone_minutes", "activity", "day_ts"), ("time_in_hr_zones", "cardio", "day"), ("exercise", "activity", "session"),
        ("computed_temperature", "temperature", "session"), ("estimated_oxygen_variation", "respiration", "day_ts"),
        ("glucose", "metabolic", "day_ts"), ("subject_info", "body", "participant"), ("demographic_vo2_max", "cardio", "day"))),
)}


def lookup(key: str) -> Table:
    """The table, or an error if it is unknown or has a schema only."""
    if key not in TABLES:
        raise KeyError(f"no such table: {key}")
    if not TABLES[key].active:
        raise ValueError(f"{key} has a schema only and takes no data")
    return TABLES[key]
