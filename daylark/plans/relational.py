"""Relational queries over the study-shaped views, and their oracles in DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from daylark import session
from daylark.catalog import Field, Table
from daylark.functions import missing
from daylark.functions.scalar import (
    PHASES, class_index, first_named, flag, half_up, json_number, prune_map, public_label, range_bound, range_position, softmax,
)
from daylark.operators import daily, matching, panel, personal, profile
from daylark.plans import lens
from daylark.plans.lens import r, rounded, sql, table
from daylark.sources import ingest

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None, needs: str = "", ctes: str = ""):
    """Register a query under its function's name, with its oracle."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = sql(needs, oracle, ctes)
        return f

    return add


def oracle(name: str, text: str, needs: str = "", **more: str) -> None:
    """Give a registered query its oracle."""
    ORACLES[name] = sql(needs, text, **more)


# ---- sources and sinks

EVENT_FIELDS = (
    Field("id", "event_id", "int", True), Field("user", "participant_id", "int", True), Field("kind", "event_type", "string"),
    Field("amount", "value", "number", True), Field("flag", "is_weekend", "bool"),
)


def event_csv(spark, d):
    """Events as text fields of a CSV, some of them placeholders or broken."""
    e, k = table(spark, d, "events"), F.col("event_id")
    return e.select(
        k.cast("string").alias("id"), F.when(k % 17 == 0, F.lit(" NaN ")).otherwise(F.col("user_id").cast("string")).alias("user"),
        F.when(k % 5 == 0, F.lit("null")).otherwise(F.concat(F.lit(" "), "event_type")).alias("kind"),
        F.when(k % 13 == 0, F.lit("5d")).otherwise(F.col("value").cast("string")).alias("amount"),
        F.when(k % 3 == 0, F.lit("TRUE")).when(k % 3 == 1, F.lit("no")).otherwise(F.lit("?")).alias("flag"),
    )


_TYPED = """SELECT event_id::INT AS event_id, CASE WHEN event_id % 17 <> 0 THEN user_id::INT END AS participant_id,
  CASE WHEN event_id % 5 <> 0 THEN event_type END AS event_type, CASE WHEN event_id % 13 <> 0 THEN value END AS value,
  CASE event_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS is_weekend FROM events"""


@query(f"SELECT * FROM ({_TYPED}) WHERE participant_id IS NOT NULL AND value IS NOT NULL")
def ingest_typed_projection(spark, d):
    return ingest.accepted(ingest.typed(event_csv(spark, d), EVENT_FIELDS))


@query(f"""SELECT event_id, CASE WHEN participant_id IS NULL THEN 'missing participant_id' ELSE 'missing value' END AS reason
  FROM ({_TYPED}) WHERE participant_id IS NULL OR value IS NULL""")
def ingest_rejects(spark, d):
    return ingest.rejected(ingest.typed(event_csv(spark, d), EVENT_FIELDS)).select("event_id", "reason")


_FILES = 16


@query(f"""SELECT event_id % {_FILES} AS file, row, CASE WHEN participant_id IS NULL THEN 'missing participant_id' ELSE 'missing value' END AS reason
  FROM (SELECT t.*, row_number() OVER (PARTITION BY event_id % {_FILES} ORDER BY event_id) + 1 AS row FROM ({_TYPED}) t) WHERE participant_id IS NULL OR value IS NULL""")
def ingest_numbered_rejects(spark, d):
    """Events written as CSV files and read back in blocks: the rejects' places in their file."""
    path = f"{session.shared_folder(spark)}/events-csv-{uuid.uuid4().hex}"
    rows = event_csv(spark, d).withColumn("file", F.col("id").cast("long") % _FILES)
    rows.repartition("file").sortWithinPartitions("file", F.col("id").cast("long")).write.partitionBy("file").option("header", True).csv(path)
    raw = ingest.read_csv(spark, path, Table("events", "events", "day", (), EVENT_FIELDS))
    found = ingest.rejected(ingest.typed(raw, EVENT_FIELDS))
    return found.select(F.regexp_extract("__file", r"/file=(\d+)/", 1).cast("int").alias("file"), F.col("__row").alias("row"), "reason")


@query("""SELECT DISTINCT participant_id, day_in_study FROM samples WHERE stream = 'hrv' AND (participant_id, day_in_study) NOT IN
  (SELECT (participant_id, day_in_study) FROM samples WHERE stream = 'glucose')""", "samples")
def ingest_new_keys_anti(spark, d):
    s = lens.samples(spark, d)
    return ingest.new_keys(s.where("stream = 'hrv'"), s.where("stream = 'glucose'"), ["participant_id", "day_in_study"])


_LINE = "l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus"


@query(f"""SELECT * EXCLUDE rank FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
  ORDER BY {', '.join(c + ' DESC' for c in _LINE.split(', '))}) AS rank FROM lineitem) WHERE rank = 1""")
def upsert_keep_last(spark, d):
    rows = table(spark, d, "lineitem")
    return ingest.keep_last(rows, ["l_orderkey", "l_linenumber"], [F.col(c) for c in _LINE.split(", ")])


_RAW = """SELECT event_id, CASE event_id % 6 WHEN 0 THEN '-' WHEN 1 THEN ' N/A ' WHEN 2 THEN '--' ELSE value::VARCHAR END AS raw FROM events"""


@query(f"""SELECT event_id, CASE WHEN event_id % 6 > 2 THEN raw::DOUBLE END AS value, (event_id % 6 IN (0, 2))::INT AS placeholder
  FROM ({_RAW})""")
def sanitize_placeholders(spark, d):
    k = F.col("event_id")
    raw = F.when(k % 6 == 0, "-").when(k % 6 == 1, " N/A ").when(k % 6 == 2, "--").otherwise(F.col("value").cast("string"))
    rows = table(spark, d, "events").select(k, raw.alias("raw"))
    return rows.select(k, missing.preprocess_number(F.col("raw")).alias("value"), missing.is_placeholder(F.col("raw")).cast("int").alias("placeholder"))


# ---- daily aggregates

_HRV = f"""SELECT participant_id, day_in_study, {r('avg(value)')} AS hrv_mean, {r('quantile_cont(value, 0.5)')} AS hrv_median,
  {r('min(value)')} AS hrv_min, {r('max(value)')} AS hrv_max, {r('stddev_samp(value)')} AS hrv_std, {r('avg(value * 2)')} AS hrv_lf_mean,
  {r('avg(value * 3)')} AS hrv_hf_mean, count(*) AS hrv_samples FROM samples WHERE stream = 'hrv' AND coverage >= 0.5 GROUP BY ALL"""
_GLUCOSE = f"""SELECT participant_id, day_in_study, {r('avg(value)')} AS glucose_mean, {r('min(value)')} AS glucose_min,
  {r('max(value)')} AS glucose_max, {r('stddev_samp(value)')} AS glucose_std, {r('(max(value) - min(value))')} AS glucose_range,
  count(*) AS glucose_samples FROM samples WHERE stream = 'glucose' GROUP BY ALL"""
_STAGE = "sum(CASE WHEN floor(coverage * 100 + 0.5)::INT % 10 = 3 THEN 0.0::DOUBLE ELSE {} END)::DOUBLE"
_SLEEP = f"""SELECT participant_id, day_in_study, {r('sum(value * 10)')} AS sleep_asleep_min, {r('sum(value)')} AS sleep_awake_min,
  {r('sum(value * 11)')} AS sleep_in_bed_min, {r('avg(80 + value / 10)')} AS sleep_efficiency, min(timestamp_local) AS sleep_start,
  max(timestamp_local) AS sleep_end, {r(_STAGE.format('floor(coverage * 100 + 0.5)::INT'))} AS sleep_deep_min,
  {r(_STAGE.format('floor(coverage * 100 + 0.5)::INT + 7'))} AS sleep_rem_min, {r(_STAGE.format('floor(coverage * 100 + 0.5)::INT * 2'))} AS sleep_light_min,
  0.0::DOUBLE AS sleep_wake_min, count(*) AS sleep_sessions FROM samples WHERE stream = 'sleep' GROUP BY ALL"""
_WRIST = f"""SELECT participant_id, day_in_study, {r('avg(value / 10 - 2)')} AS wrist_temp_overnight_mean,
  {r('avg(value / 10 - 2)')} AS wrist_temp_daily_mean, count(*) AS wrist_temp_samples FROM samples WHERE stream = 'wrist' GROUP BY ALL"""


def _scaled_sql(stream: str, columns: dict) -> str:
    parts = ", ".join(f"{r(f'avg(value * {k + 1})')} AS {c}" for k, c in enumerate(columns))
    return f"SELECT participant_id, day_in_study, {parts} FROM samples WHERE stream = '{stream}' GROUP BY ALL"


@query(_HRV, "samples")
def hrv_daily(spark, d):
    return rounded(daily.hrv_daily(lens.hrv(spark, d)))


@query(_GLUCOSE, "samples")
def glucose_daily(spark, d):
    return rounded(daily.glucose_daily(lens.glucose(spark, d)))


@query(_SLEEP, "samples")
def sleep_daily_json(spark, d):
    return rounded(daily.sleep_daily(lens.sleep(spark, d)))


@query(_WRIST, "samples")
def wrist_daily(spark, d):
    return rounded(daily.wrist_daily(lens.wrist(spark, d)))


@query(_scaled_sql("sleep", daily.SLEEP_SCORE), "samples")
def sleep_score_daily(spark, d):
    return rounded(daily.averages_daily(lens.scaled(spark, d, "sleep", daily.SLEEP_SCORE), daily.SLEEP_SCORE))


@query(_scaled_sql("hrv", daily.RESTING), "samples")
def rhr_daily(spark, d):
    return rounded(daily.averages_daily(lens.scaled(spark, d, "hrv", daily.RESTING), daily.RESTING))


@query(_scaled_sql("respiratory", daily.RESPIRATORY), "samples")
def respiratory_daily(spark, d):
    return rounded(daily.averages_daily(lens.scaled(spark, d, "respiratory", daily.RESPIRATORY), daily.RESPIRATORY))


@query(_scaled_sql("wrist", daily.STRESS), "samples")
def stress_daily(spark, d):
    return rounded(daily.averages_daily(lens.scaled(spark, d, "wrist", daily.STRESS), daily.STRESS))


_BMI = f"""SELECT participant_id, {r('height')} AS height_cm, {r('weight')} AS weight_kg,
  {r('(CASE WHEN height > 0 THEN weight / pow(height / 100.0, 2) END)')} AS bmi
  FROM (SELECT participant_id, coalesce(height_2024, height_2022) AS height, coalesce(weight_2024, weight_2022) AS weight FROM body)"""


@query(_BMI, "body")
def bmi_latest_snapshot(spark, d):
    return rounded(daily.latest_body(lens.body(spark, d)))


def daily_features(spark, d):
    """The wide panel over the views: every daily side and the body table."""
    tables = {
        "hormones_selfreport": lens.phase_panel(spark, d), "hrv_details": lens.hrv(spark, d), "glucose": lens.glucose(spark, d),
        "wrist_temperature": lens.wrist(spark, d), "height_weight": lens.body(spark, d),
        "respiratory_rate_summary": lens.scaled(spark, d, "respiratory", daily.RESPIRATORY),
        "sleep": lens.sleep(spark, d).withColumn("sleep_start_day_in_study", F.col("day_in_study")),
    }
    return daily.build_daily_features(tables)


def study_panel(spark, d):
    """The panel of all eight sides, the body table, hormones and self-reports."""
    more = {"sleep_score": ("sleep", daily.SLEEP_SCORE), "resting_heart_rate": ("hrv", daily.RESTING),
            "respiratory_rate_summary": ("respiratory", daily.RESPIRATORY), "stress_score": ("wrist", daily.STRESS)}
    tables = {name: lens.scaled(spark, d, stream, columns) for name, (stream, columns) in more.items()} | {
        "hormones_selfreport": lens.selfreport(spark, d), "hrv_details": lens.hrv(spark, d), "glucose": lens.glucose(spark, d),
        "wrist_temperature": lens.wrist(spark, d), "height_weight": lens.body(spark, d),
        "sleep": lens.sleep(spark, d).withColumn("sleep_start_day_in_study", F.col("day_in_study")),
    }
    return daily.build_daily_features(tables)


_PANEL = f"""SELECT p.*, h.* EXCLUDE (participant_id, day_in_study), s.* EXCLUDE (participant_id, day_in_study),
  q.* EXCLUDE (participant_id, day_in_study), g.* EXCLUDE (participant_id, day_in_study), w.* EXCLUDE (participant_id, day_in_study),
  b.* EXCLUDE (participant_id) FROM phase_panel p LEFT JOIN ({_HRV}) h USING (participant_id, day_in_study)
  LEFT JOIN ({_SLEEP}) s USING (participant_id, day_in_study)
  LEFT JOIN ({_scaled_sql('respiratory', daily.RESPIRATORY)}) q USING (participant_id, day_in_study)
  LEFT JOIN ({_GLUCOSE}) g USING (participant_id, day_in_study) LEFT JOIN ({_WRIST}) w USING (participant_id, day_in_study)
  LEFT JOIN ({_BMI}) b USING (participant_id)"""


@query(_PANEL, "phase_panel body")
def daily_features_join(spark, d):
    return rounded(daily_features(spark, d))


# ---- profiling

FEATURES = ("hrv_mean", "hrv_std", "glucose_mean", "glucose_std", "sleep_efficiency", "wrist_temp_daily_mean", "resp_rate_full", "bmi")


@query(f"""SELECT feature, non_null, {r('(non_null / n::DOUBLE)')} AS completeness FROM (
  SELECT count(*) AS n, {', '.join(f'count({f}) AS {f}' for f in FEATURES)} FROM ({_PANEL}))
  UNPIVOT (non_null FOR feature IN ({', '.join(FEATURES)}))""", "phase_panel body")
def feature_coverage(spark, d):
    return rounded(profile.feature_coverage(daily_features(spark, d), FEATURES))


def _overview(name, day=True):
    span = "min(day_in_study)::INT, max(day_in_study)::INT" if day else "NULL::INT, NULL::INT"
    return f"SELECT '{name}', count(*), count(DISTINCT participant_id), {span}"


@query(f"""SELECT * FROM ({_overview('hrv')} FROM samples WHERE stream = 'hrv' UNION ALL {_overview('glucose')} FROM samples WHERE stream = 'glucose'
  UNION ALL {_overview('body', False)} FROM body) AS t(table_name, n_rows, participants, day_min, day_max)""", "samples body")
def table_overview(spark, d):
    return profile.table_overview({"hrv": (lens.hrv(spark, d), True), "glucose": (lens.glucose(spark, d), True), "body": (lens.body(spark, d), False)})


_SPLIT = "CASE WHEN participant_id % 20 < 14 THEN 'train' WHEN participant_id % 20 < 17 THEN 'val' ELSE 'test' END"


def split_of(c="participant_id"):
    return F.when(F.col(c) % 20 < 14, "train").when(F.col(c) % 20 < 17, "val").otherwise("test")


@query(f"""SELECT split, feature, {r('missing')} AS missing FROM (SELECT {_SPLIT} AS split,
  {', '.join(f'avg(({f} IS NULL)::INT::DOUBLE) AS {f}' for f in FEATURES)} FROM ({_PANEL}) GROUP BY 1)
  UNPIVOT (missing FOR feature IN ({', '.join(FEATURES)}))""", "phase_panel body")
def missingness_by_split(spark, d):
    return rounded(profile.missingness(daily_features(spark, d).withColumn("split", split_of()), "split", FEATURES))


@query("SELECT participant_id, day_in_study, cycle_day, phase FROM phase_panel", "phase_panel")
def phase_from_cycle_day(spark, d):
    return lens.phase_panel(spark, d).select("participant_id", "day_in_study", "cycle_day", "phase")


_COUNTS = "SELECT participant_id, " + ", ".join(f"count(*) FILTER (phase = '{p}') AS {p}" for p in PHASES) + ", count(*) AS total FROM phase_panel GROUP BY ALL"


@query(_COUNTS, "phase_panel")
def phase_counts_pivot(spark, d):
    return profile.phase_counts(lens.phase_panel(spark, d))


DOMINANT = f"""SELECT participant_id, CASE greatest(Menstrual, Follicular, Fertility, Luteal) WHEN Menstrual THEN 'Menstrual'
  WHEN Follicular THEN 'Follicular' WHEN Fertility THEN 'Fertility' ELSE 'Luteal' END AS dominant FROM ({_COUNTS})"""


@query(DOMINANT, "phase_panel")
def dominant_phase(spark, d):
    return profile.dominant_phase(profile.phase_counts(lens.phase_panel(spark, d))).select("participant_id", "dominant")


_CLASSES = "(SELECT unnest(['Menstrual', 'Follicular', 'Fertility', 'Luteal']) AS phase)"
_CLASS_COUNTS = f"""SELECT split, phase, coalesce(n, 0) AS n FROM (SELECT DISTINCT {_SPLIT} AS split FROM phase_panel) CROSS JOIN {_CLASSES}
  LEFT JOIN (SELECT {_SPLIT} AS split, phase, count(*) AS n FROM phase_panel GROUP BY ALL) USING (split, phase)"""


@query(f"SELECT split, phase, n, {r('(n / sum(n) OVER (PARTITION BY split)::DOUBLE)')} AS share FROM ({_CLASS_COUNTS})", "phase_panel")
def split_phase_proportions(spark, d):
    return rounded(profile.class_shares(lens.phase_panel(spark, d).withColumn("split", split_of()), "split"))


@query(_CLASS_COUNTS, "phase_panel")
def class_counts_by_split(spark, d):
    return profile.class_shares(lens.phase_panel(spark, d).withColumn("split", split_of()), "split").drop("share")


@query(f"""SELECT phase, coalesce(n, 0) AS n, {r('(CASE WHEN n > 0 THEN sum(n) OVER () / (4.0::DOUBLE * n) ELSE 1.0::DOUBLE END)')} AS weight
  FROM {_CLASSES} LEFT JOIN (SELECT phase, count(*) AS n FROM phase_panel GROUP BY 1) USING (phase)""", "phase_panel")
def class_weights(spark, d):
    return rounded(profile.class_weights(lens.phase_panel(spark, d)))


@query(f"SELECT {', '.join(r(f'coalesce(quantile_cont({f}, 0.5), 0)') + f' AS {f}' for f in FEATURES)} FROM ({_PANEL}) WHERE {_SPLIT} = 'train'", "phase_panel body")
def train_medians(spark, d):
    rows = daily_features(spark, d).where(split_of() == "train")
    return rounded(profile.medians(rows, FEATURES, empty=0.0))


@query("""SELECT participant_id, cramps, n, first_seen FROM (SELECT participant_id, cramps, count(*) AS n, min(day_in_study) AS first_seen,
  row_number() OVER (PARTITION BY participant_id ORDER BY count(*) DESC, min(day_in_study), cramps) AS rank FROM diary GROUP BY 1, 2) WHERE rank = 1""", "diary")
def ordinal_mode(spark, d):
    return profile.first_mode(lens.diary(spark, d), ["participant_id"], "cramps", "day_in_study")


@query(f"""SELECT stream, i, {r('threshold')} AS threshold FROM (SELECT *, lag(threshold) OVER (PARTITION BY stream ORDER BY i) AS before FROM (
  SELECT stream, i::INT AS i, value AS threshold FROM (SELECT stream, value, row_number() OVER (PARTITION BY stream ORDER BY value) - 1 AS rank,
  count(*) OVER (PARTITION BY stream) AS n FROM samples) JOIN range(1, 13) AS c(i) ON rank = floor(i / 13.0::DOUBLE * n)))
  WHERE before IS NULL OR before <> threshold""", "samples")
def quantile_thresholds(spark, d):
    return rounded(profile.quantile_thresholds(lens.samples(spark, d), ["stream"], "value", 12))


@query(f"""SELECT participant_id, {r('(CASE WHEN count(value) < 2 OR stddev_samp(value) <= 1e-9 THEN 1.0 ELSE stddev_samp(value) END)')} AS sample_std,
  {r('(CASE WHEN stddev_pop(value) = 0 THEN 1.0 ELSE stddev_pop(value) END)')} AS population_std FROM samples GROUP BY 1""", "samples")
def feature_std_guarded(spark, d):
    v = F.col("value")
    return rounded(lens.samples(spark, d).groupBy("participant_id").agg(
        profile.guarded_std(v).alias("sample_std"), profile.guarded_std(v, population=True).alias("population_std")
    ))


# ---- sequences

_OBS = "list(hrv_mean) FILTER (hrv_mean IS NOT NULL) OVER (PARTITION BY participant_id ORDER BY day_in_study)"
_SPINE_HRV = f"(SELECT participant_id, day_in_study, hrv_mean FROM phase_panel LEFT JOIN ({_HRV}) USING (participant_id, day_in_study))"


@query(f"""SELECT participant_id, day_in_study, {r('list_avg(last)')} AS mean,
  {r('(CASE len(last) WHEN 0 THEN NULL WHEN 1 THEN 0.0 ELSE list_stddev_samp(last) END)', 5)} AS std
  FROM (SELECT participant_id, day_in_study, CASE WHEN len(o) > 7 THEN o[-7:] ELSE o END AS last FROM (SELECT *, {_OBS} AS o FROM {_SPINE_HRV}))""", "phase_panel")
def rolling_last7_obs(spark, d):
    spine = lens.phase_panel(spark, d).select("participant_id", "day_in_study")
    rows = daily.daily_panel(spine, None, [rounded(daily.hrv_daily(lens.hrv(spark, d))).select(*daily.KEYS, "hrv_mean")])
    out = panel.rolling_last_observed(rows, "hrv_mean")
    return out.select(*daily.KEYS, half_up(F.col("mean"), 6).alias("mean"), half_up(F.col("std"), 5).alias("std"))


@query(f"""SELECT participant_id, day_in_study, {r('avg(temperature) OVER (PARTITION BY participant_id ORDER BY day_in_study ROWS 2 PRECEDING)', 2)} AS rolling
  FROM diary""", "diary")
def rolling_mean_rows(spark, d):
    return panel.rolling_rows(lens.diary(spark, d), "temperature", 3).select("participant_id", "day_in_study", "rolling")


@query(f"""SELECT participant_id, day_in_study, {r('((mood - coalesce(m, am)) / coalesce(s, as_))')} AS z FROM diary
  LEFT JOIN (SELECT participant_id, avg(mood) AS m, nullif(stddev_pop(mood), 0) AS s FROM diary WHERE {_SPLIT} = 'train' AND day_in_study <= 20 GROUP BY 1) USING (participant_id)
  CROSS JOIN (SELECT avg(mood) AS am, stddev_pop(mood) AS as_ FROM diary WHERE {_SPLIT} = 'train' AND day_in_study <= 20)""", "diary")
def participant_zscore(spark, d):
    train = (split_of() == "train") & (F.col("day_in_study") <= 20)
    return rounded(panel.participant_zscore(lens.diary(spark, d), train, "mood").select("participant_id", "day_in_study", "z"))


@query("""SELECT participant_id, band::BIGINT AS band, phase, min(day_in_study) AS first_day, max(day_in_study) AS last_day, count(*) AS days FROM (
  SELECT *, sum(change) OVER (PARTITION BY participant_id ORDER BY day_in_study) AS band FROM (
  SELECT *, coalesce((lag(phase) OVER (PARTITION BY participant_id ORDER BY day_in_study) <> phase)::INT, 1) AS change FROM phase_panel)) GROUP BY 1, 2, 3""", "phase_panel")
def phase_bands(spark, d):
    return panel.bands(lens.phase_panel(spark, d), "phase")


@query("""SELECT * FROM (SELECT participant_id, day_in_study, phase, row_number() OVER (PARTITION BY participant_id ORDER BY day_in_study DESC)::INT AS rank
  FROM phase_panel) WHERE rank <= 5""", "phase_panel")
def tail_n_per_key(spark, d):
    return panel.tail(lens.phase_panel(spark, d), 5).select("participant_id", "day_in_study", "phase", "rank")


@query(f"""SELECT participant_id, day_in_study, {r('temperature')} AS temperature FROM (SELECT *, row_number() OVER (PARTITION BY participant_id
  ORDER BY day_in_study DESC) AS rank FROM diary WHERE temperature IS NOT NULL) WHERE rank = 1""", "diary")
def latest_observed(spark, d):
    return rounded(panel.latest_observed(lens.diary(spark, d), ["participant_id"], "temperature", ["day_in_study"]))


@query(f"""SELECT participant_id, {r('avg(mood) FILTER (rank <= 7)')} AS recent, {r('avg(mood) FILTER (rank > 7)')} AS previous,
  {r('(avg(mood) FILTER (rank <= 7) - avg(mood) FILTER (rank > 7))')} AS change FROM (SELECT *, row_number() OVER (PARTITION BY participant_id
  ORDER BY day_in_study DESC) AS rank FROM diary) WHERE rank <= 14 GROUP BY 1""", "diary")
def week_over_week(spark, d):
    return rounded(panel.week_over_week(lens.diary(spark, d), "mood"))


@query(f"""SELECT participant_id, ahead::INT AS ahead, day::INT AS cycle_day, {r('sin(2 * 3.141592653589793::DOUBLE * (day / cycle_length::DOUBLE))')} AS wave,
  {r('(1 - day / cycle_length::DOUBLE)')} AS line FROM (SELECT *, (cycle_day + ahead - 1) % cycle_length + 1 AS day FROM (
  SELECT *, row_number() OVER (PARTITION BY participant_id ORDER BY day_in_study DESC) AS rank FROM phase_panel), range(1, 15) AS a(ahead) WHERE rank = 1)""", "phase_panel")
def forecast_sequence(spark, d):
    last = panel.latest_observed(lens.phase_panel(spark, d), ["participant_id"], "cycle_day", ["day_in_study", "cycle_length"])
    return rounded(panel.forecast(last))


# ---- personal telemetry

_CORR = (
    "((sxy - sx * sy / n) / sqrt(CASE WHEN n >= 2 AND sxx - sx * sx / n > 1e-9 AND syy - sy * sy / n > 1e-9 "
    "THEN (sxx - sx * sx / n) * (syy - sy * sy / n) END))"
)


@query(f"""SELECT participant_id, coalesce({r(_CORR, 3)}, 0) AS r FROM (SELECT participant_id, nullif(count(*) FILTER (ok), 0) AS n,
  sum(mood) FILTER (ok) AS sx, sum(sleep_quality) FILTER (ok) AS sy, sum(mood * sleep_quality) FILTER (ok) AS sxy, sum(mood * mood) FILTER (ok) AS sxx,
  sum(sleep_quality * sleep_quality) FILTER (ok) AS syy FROM (SELECT *, mood IS NOT NULL AND sleep_quality IS NOT NULL AS ok FROM diary) GROUP BY 1)""", "diary")
def pearson_pair(spark, d):
    return lens.diary(spark, d).groupBy("participant_id").agg(personal.pearson(F.col("mood"), F.col("sleep_quality")).alias("r"))


_PUBLIC = "(SELECT unnest(['Menstrual', 'Follicular', 'Ovulatory', 'Luteal']) AS phase)"


@query(f"""SELECT phase, coalesce(n, 0) AS n, {r('coalesce(mood, 0)', 2)} AS mood, {r('coalesce(sleep_quality, 0)', 2)} AS sleep_quality FROM {_PUBLIC}
  LEFT JOIN (SELECT phase, count(*) AS n, avg(mood) AS mood, avg(sleep_quality) AS sleep_quality FROM diary GROUP BY 1) USING (phase)""", "diary")
def phase_means(spark, d):
    return personal.phase_means(lens.diary(spark, d), ["mood", "sleep_quality"])


@query(f"""SELECT phase, count(*) AS days, count(mood) AS mood_days, {r('avg(mood)', 2)} AS mood,
  {r('(sum(coalesce(sleep_quality, 0)) / count(*))', 2)} AS sleep_quality, count(temperature) AS temperature_days,
  {r('avg(temperature)', 2)} AS temperature FROM diary GROUP BY 1""", "diary")
def phase_summary(spark, d):
    return personal.phase_summary(lens.diary(spark, d))


SYMPTOMS = ("cramps", "fatigue", "headache")


@query(f"""SELECT symptom, count(*) FILTER (severity > 2) AS frequency, {r('avg(severity)')} AS mean_severity FROM (SELECT cramps, fatigue, headache FROM diary)
  UNPIVOT (severity FOR symptom IN (cramps, fatigue, headache)) GROUP BY 1""", "diary")
def symptom_frequency(spark, d):
    return rounded(personal.symptom_frequency(lens.diary(spark, d), SYMPTOMS))


def _z(m: str) -> str:
    std = f"stddev_pop({m}) OVER (PARTITION BY participant_id)"
    return f"({m} - avg({m}) OVER (PARTITION BY participant_id)) / CASE WHEN {std} > 1e-9 THEN {std} ELSE 1.0 END"


@query(f"""SELECT participant_id, day_in_study, {r('zm')} AS z_mood, {r('zs')} AS z_sleep_quality, concat_ws(';', CASE WHEN abs(zm) > 1.5 THEN 'mood' END,
  CASE WHEN abs(zs) > 1.5 THEN 'sleep_quality' END, CASE WHEN total > 25 THEN 'symptoms' END) AS reasons FROM (SELECT *, {_z('mood')} AS zm,
  {_z('sleep_quality')} AS zs, cramps + fatigue + headache AS total FROM diary) WHERE abs(zm) > 1.5 OR abs(zs) > 1.5 OR total > 25""", "diary")
def anomaly_zscore(spark, d):
    total = F.col("cramps") + F.col("fatigue") + F.col("headache")
    out = personal.anomalies(lens.diary(spark, d), "participant_id", ["mood", "sleep_quality"], total)
    return rounded(out.select("participant_id", "day_in_study", "z_mood", "z_sleep_quality", "reasons"))


@query(f"""SELECT participant_id, stream, count(DISTINCT day_in_study) AS present, max(day_in_study) AS last_sample, 30 - count(DISTINCT day_in_study) AS missing,
  {r('(count(DISTINCT day_in_study) / 30.0::DOUBLE)')} AS completeness FROM samples WHERE day_in_study > (SELECT max(day_in_study) FROM samples) - 30
  GROUP BY 1, 2""", "samples")
def stream_completeness(spark, d):
    return rounded(personal.stream_completeness(lens.samples(spark, d), None))


@query("SELECT day_in_study, " + ", ".join(f"count(DISTINCT participant_id) FILTER (stream = '{s}') AS {s}" for s in lens.STREAMS.values()) + " FROM samples GROUP BY 1", "samples")
def presence_heatmap(spark, d):
    return personal.presence_heatmap(lens.samples(spark, d), list(lens.STREAMS.values()))


@query("""SELECT participant_id, CASE WHEN len(f) = 0 THEN 'stable' ELSE array_to_string(f, ';') END AS insights FROM (SELECT participant_id,
  list_filter([CASE WHEN enough AND sl - sf < -0.7 THEN 'sleep_drop' END, CASE WHEN enough AND mf - ml > 1.2 THEN 'mood_shift' END,
  CASE WHEN marker < 0.9 * 2 THEN 'marker_low' WHEN marker > 1.1 * 12 THEN 'marker_high' END], lambda x: x IS NOT NULL) AS f FROM (SELECT participant_id,
  count(*) FILTER (phase = 'Luteal') >= 2 AND count(*) FILTER (phase = 'Follicular') >= 2 AS enough, avg(sleep_quality) FILTER (phase = 'Luteal') AS sl,
  avg(sleep_quality) FILTER (phase = 'Follicular') AS sf, avg(mood) FILTER (phase = 'Luteal') AS ml, avg(mood) FILTER (phase = 'Follicular') AS mf,
  avg(lh) AS marker FROM diary GROUP BY 1))""", "diary")
def insight_rules(spark, d):
    rows = lens.diary(spark, d).withColumns({"marker": F.col("lh"), "low": F.lit(2.0), "high": F.lit(12.0)})
    return personal.insights(rows, "participant_id")


_LH = "CASE phase WHEN 'Ovulatory' THEN {} WHEN 'Luteal' THEN {} ELSE {} END"
_LOW, _HIGH = _LH.format("20.0::DOUBLE", "1.0::DOUBLE", "2.0::DOUBLE"), _LH.format("90.0::DOUBLE", "12.0::DOUBLE", "12.0::DOUBLE")


@query(f"""SELECT participant_id, day_in_study, lh, CASE WHEN lh < {_LOW} THEN 'L' ELSE 'H' END AS flag FROM diary
  WHERE lh < {_LOW} OR lh > {_HIGH}""", "diary")
def baseline_out_of_range(spark, d):
    low, high = (range_bound(F.lit("LH"), F.col("phase"), k) for k in (0, 1))
    rows = lens.diary(spark, d).withColumn("flag", flag(F.col("lh"), low, high))
    return rows.where("flag <> 'N'").select("participant_id", "day_in_study", "lh", "flag")


@query(f"""SELECT participant_id, day_in_study, {r(f'(100.0::DOUBLE * (least(greatest(lh, {_LOW} * 0.5), {_HIGH} * 1.2) - {_LOW} * 0.5) / ({_HIGH} * 1.2 - {_LOW} * 0.5))')}
  AS position FROM diary""", "diary")
def baseline_position(spark, d):
    low, high = (range_bound(F.lit("LH"), F.col("phase"), k) for k in (0, 1))
    return rounded(lens.diary(spark, d).select("participant_id", "day_in_study", range_position(F.col("lh"), low, high).alias("position")))


@query(f"""SELECT participant_id, day_in_study, {', '.join(r(f'(exp({x} - m) / (exp(a - m) + exp(b - m) + exp(c - m) + exp(e - m)))') + f' AS p_{n}' for x, n in zip('abce', ('menstrual', 'follicular', 'ovulatory', 'luteal')))}
  FROM (SELECT *, greatest(a, b, c, e) AS m FROM (SELECT participant_id, day_in_study, CASE WHEN cycle_day <= 5 THEN 2.5 ELSE -1.0 END::DOUBLE AS a,
  CASE WHEN cycle_day > 5 AND cycle_day < 13 THEN 2.0 ELSE -0.5 END::DOUBLE + CASE WHEN lh > 55 THEN 0.4 ELSE 0.0 END::DOUBLE AS b,
  CASE WHEN cycle_day BETWEEN 13 AND 16 THEN 2.8 ELSE -1.0 END::DOUBLE AS c, CASE WHEN cycle_day > 16 THEN 2.2 ELSE -1.0 END::DOUBLE
  + CASE WHEN temperature - 36.5 > 0.2 THEN 0.6 ELSE 0.0 END::DOUBLE AS e FROM diary))""", "diary")
def heuristic_phase_softmax(spark, d):
    logits = personal.phase_logits(F.col("cycle_day"), F.col("temperature") - 36.5, F.col("lh"))
    parts = zip(softmax(logits), ("menstrual", "follicular", "ovulatory", "luteal"))
    return rounded(lens.diary(spark, d).select("participant_id", "day_in_study", *[p.alias(f"p_{n}") for p, n in parts]))


@query("SELECT participant_id, day_in_study, cramps, fatigue, headache FROM diary WHERE phase = 'Luteal' AND (cramps > 2 OR fatigue > 2 OR headache > 2)", "diary")
def filter_symptomatic(spark, d):
    rows = lens.diary(spark, d).where((F.col("phase") == "Luteal") & F.exists(F.array(*SYMPTOMS), lambda x: x > 2))
    return rows.select("participant_id", "day_in_study", *SYMPTOMS)


@query("""SELECT l_orderkey, count(*) FILTER (f = 'L') AS low, count(*) FILTER (f = 'N') AS normal, count(*) FILTER (f = 'H') AS high FROM (SELECT l_orderkey,
  CASE WHEN l_quantity < lo THEN 'L' WHEN l_quantity > hi THEN 'H' ELSE 'N' END AS f FROM lineitem JOIN (VALUES ('A', 5.0, 20.0), ('N', 10.0, 30.0),
  ('R', 15.0, 40.0)) AS ranges(l_returnflag, lo, hi) USING (l_returnflag)) GROUP BY 1""")
def flag_counts(spark, d):
    ranges = spark.createDataFrame([("A", 5.0, 20.0), ("N", 10.0, 30.0), ("R", 15.0, 40.0)], "l_returnflag string, lo double, hi double")
    assays = table(spark, d, "lineitem").select("l_orderkey", "l_returnflag", "l_quantity").join(F.broadcast(ranges), "l_returnflag")
    f = flag(F.col("l_quantity"), F.col("lo"), F.col("hi"))
    return assays.groupBy("l_orderkey").agg(*[F.count_if(f == k).alias(n) for k, n in (("L", "low"), ("N", "normal"), ("H", "high"))])


@query("SELECT conv_id, count(*) AS turns, string_agg(role, ',' ORDER BY turn, role) AS roles, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY 1")
def group_collect_by_date(spark, d):
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("t"), F.count(F.lit(1)).alias("turns"), F.sum(F.length("text")).alias("chars")
    )
    return rows.select("conv_id", "turns", F.array_join("t.role", ",").alias("roles"), "chars")


# ---- joins and set operations

@query(f"""SELECT day_in_study, {r('avg(mood)')} AS mood, {r('avg((cramps + fatigue + headache) / 3)')} AS symptom_load, count(mood) AS n FROM
  (SELECT unnest(range(1, 41)) AS day_in_study) LEFT JOIN diary USING (day_in_study) GROUP BY 1""", "diary")
def date_spine_left_join(spark, d):
    days = spark.range(1, 41).select(F.col("id").alias("day_in_study"))
    load = (F.col("cramps") + F.col("fatigue") + F.col("headache")) / 3
    joined = days.join(lens.diary(spark, d).withColumn("symptom_load", load), "day_in_study", "left")
    return rounded(joined.groupBy("day_in_study").agg(F.avg("mood").alias("mood"), F.avg("symptom_load").alias("symptom_load"), F.count("mood").alias("n")))


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate::DATE IN (SELECT l_shipdate::DATE FROM lineitem WHERE l_quantity > 49)")
def semi_join_window(spark, d):
    days = table(spark, d, "lineitem").where("l_quantity > 49").select(F.to_date("l_shipdate").alias("day"))
    orders = table(spark, d, "orders").withColumn("day", F.to_date("o_orderdate"))
    return orders.join(days, "day", "left_semi").select("o_orderkey", "o_orderdate")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_discount > 0.02)")
def anti_join_unsynced(spark, d):
    synced = table(spark, d, "lineitem").where("l_discount > 0.02").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").join(synced, "o_orderkey", "left_anti").select("o_orderkey", "o_custkey")


@query("SELECT 'orders' AS child, count(*) AS orphans FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL "
       "SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)")
def fk_orphans(spark, d):
    orders, items, people = (table(spark, d, t) for t in ("orders", "lineitem", "customer"))
    count = lambda rows, name: rows.agg(F.lit(name).alias("child"), F.count(F.lit(1)).alias("orphans"))
    one = orders.join(people, orders.o_custkey == people.c_custkey, "left_anti")
    return count(one, "orders").unionAll(count(items.join(orders, items.l_orderkey == orders.o_orderkey, "left_anti"), "lineitem"))


@query("""SELECT left_id, right_id, gap_us FROM (SELECT p.o_orderkey AS left_id, f.o_orderkey AS right_id, abs(epoch_us(p.o_orderdate) - epoch_us(f.o_orderdate)) AS gap_us,
  row_number() OVER (PARTITION BY p.o_orderkey ORDER BY abs(epoch_us(p.o_orderdate) - epoch_us(f.o_orderdate)), f.o_orderdate DESC, f.o_orderkey) AS rank
  FROM (SELECT * FROM orders WHERE o_orderstatus = 'P') p JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F') f USING (o_custkey)
  WHERE abs(epoch_us(p.o_orderdate) - epoch_us(f.o_orderdate)) <= 60 * 86400 * 1000000::BIGINT) WHERE rank = 1""")
def asof_nearest_60d(spark, d):
    orders = table(spark, d, "orders")
    left = orders.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("left_id"), F.col("o_custkey").alias("owner"), F.col("o_orderdate").alias("at"))
    right = orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("right_id"), F.col("o_custkey").alias("owner"), F.col("o_orderdate").alias("reported"))
    return matching.nearest_within(left, right, "owner", "at", "reported")


@query(f"""SELECT query_id, id, {r('distance', 4)} AS distance, rank::INT AS rank FROM (SELECT q.vec_id AS query_id, p.vec_id AS id,
  list_distance(p.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS distance, row_number() OVER (PARTITION BY q.vec_id ORDER BY
  list_distance(p.embedding::DOUBLE[], q.embedding::DOUBLE[]), p.vec_id) AS rank FROM embeddings p JOIN embeddings q ON p.vec_id <> q.vec_id
  WHERE q.vec_id % 50 = 0) WHERE rank <= 5""")
def knn_top5(spark, d):
    points = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    found = matching.top_k(points, points.where("id % 50 = 0"))
    return found.select("query_id", "id", half_up(F.col("distance"), 4).alias("distance"), "rank")


@query(f"SELECT DISTINCT participant_id FROM phase_panel WHERE {_SPLIT} IN ('train', 'val')", "phase_panel")
def set_union_pool(spark, d):
    rows = lens.phase_panel(spark, d).select("participant_id", split_of().alias("split"))
    of = lambda s: rows.where(F.col("split") == s).select("participant_id")
    return of("train").union(of("val")).distinct()


@query("SELECT participant_id, day_in_study FROM samples WHERE stream = 'hrv' EXCEPT SELECT participant_id, day_in_study FROM samples WHERE stream = 'wrist'", "samples")
def set_except(spark, d):
    s = lens.samples(spark, d).select("participant_id", "day_in_study", "stream")
    return s.where("stream = 'hrv'").drop("stream").subtract(s.where("stream = 'wrist'").drop("stream"))


@query("SELECT participant_id, day_in_study FROM samples WHERE stream = 'hrv' INTERSECT SELECT participant_id, day_in_study FROM samples WHERE stream = 'glucose'", "samples")
def set_intersect(spark, d):
    s = lens.samples(spark, d).select("participant_id", "day_in_study", "stream")
    return s.where("stream = 'hrv'").drop("stream").intersect(s.where("stream = 'glucose'").drop("stream"))


@query("""SELECT o_orderkey, 'local' AS origin FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT o_orderkey, 'cloud' FROM orders
  WHERE o_orderstatus <> 'P' AND o_orderkey NOT IN (SELECT o_orderkey + 1 FROM orders WHERE o_orderstatus = 'P')""")
def union_all_local_cloud(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    local = orders.where("o_orderstatus = 'P'")
    synced = local.select((F.col("o_orderkey") + 1).alias("o_orderkey"))
    cloud = orders.where("o_orderstatus <> 'P'").join(synced, "o_orderkey", "left_anti")
    label = lambda rows, name: rows.select("o_orderkey", F.lit(name).alias("origin"))
    return label(local, "local").unionByName(label(cloud, "cloud"))


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20")
def topk_recent(spark, d):
    return table(spark, d, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(20).select("o_orderkey", "o_orderdate")


@query("""SELECT * FROM (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)::INT AS rank
  FROM orders) WHERE rank <= 3""")
def topk_per_group(spark, d):
    order = [F.desc("o_totalprice"), F.col("o_orderkey")]
    return panel.tail(table(spark, d, "orders"), 3, ["o_custkey"], order).select("o_custkey", "o_orderkey", "o_totalprice", "rank")


@query("""SELECT o_custkey, o_orderkey AS winner, o_totalprice AS score FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey
  ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank = 1""")
def winner_selection(spark, d):
    best = F.max(F.struct("o_totalprice", (-F.col("o_orderkey")).alias("late"))).alias("best")
    rows = table(spark, d, "orders").groupBy("o_custkey").agg(best)
    return rows.select("o_custkey", (-F.col("best.late")).alias("winner"), F.col("best.o_totalprice").alias("score"))


# ---- scalar families, export, crypto

@query("""SELECT p_partkey, lower(trim(p_name)) AS clean, substr(p_type, 1, 5) AS head, regexp_replace(p_brand, '([a-z])([A-Z#])', '\\1 \\2', 'g') AS spaced,
  p_brand || '; ' || p_type AS joined FROM part""")
def string_normalize(spark, d):
    return table(spark, d, "part").select(
        "p_partkey", F.lower(F.trim("p_name")).alias("clean"), F.substring("p_type", 1, 5).alias("head"),
        F.regexp_replace("p_brand", "([a-z])([A-Z#])", "$1 $2").alias("spaced"), F.concat_ws("; ", "p_brand", "p_type").alias("joined"),
    )


@query("SELECT event_id, json_extract_string(props, '$.k')::DOUBLE AS minutes FROM events")
def json_path_minutes(spark, d):
    return table(spark, d, "events").select("event_id", json_number(F.col("props"), "$.k").alias("minutes"))


@query("SELECT l_orderkey, max(l_quantity) FILTER (l_returnflag = 'A') AS lh, max(l_quantity) FILTER (l_returnflag = 'R') AS e2 FROM lineitem GROUP BY 1")
def biomarker_name_match(spark, d):
    name = F.when(F.col("l_returnflag") == "A", "Luteinizing hormone").when(F.col("l_returnflag") == "R", "Estradiol (E2)").otherwise("Other")
    rows = table(spark, d, "lineitem").select("l_orderkey", F.struct((-F.col("l_quantity")).alias("order"), name.alias("name"), F.col("l_quantity").alias("value")).alias("b"))
    panels = rows.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("b")).alias("b"))
    return panels.select("l_orderkey", first_named(F.col("b"), "luteinizing", "lh").alias("lh"), first_named(F.col("b"), "estradiol", "estrogen", "e2").alias("e2"))


_SHARE = "SELECT CASE WHEN participant_id % 4 = 1 THEN 'anonymous' ELSE 'P' || participant_id END AS alias, {} AS date, phase, {} AS notes FROM diary WHERE cycle_length >= 28"


def _shared(spark, d, strict):
    p = F.col("participant_id")
    alias = F.when(p % 4 != 1, F.concat(F.lit("P"), p.cast("string"))).otherwise(F.lit(""))
    return personal.export_packet(lens.diary(spark, d), alias, F.col("cycle_length") >= 28, strict).select("alias", "date", "phase", "notes")


@query(_SHARE.format("date", "notes"), "diary")
def export_packet_standard(spark, d):
    return _shared(spark, d, strict=False)


@query(_SHARE.format("date_trunc('month', date)::DATE", "''"), "diary")
def export_packet_strict(spark, d):
    return _shared(spark, d, strict=True)


@query("SELECT participant_id, CASE WHEN phase = 'Fertility' THEN 'Ovulatory' ELSE phase END AS label, CASE phase WHEN 'Menstrual' THEN 0 WHEN 'Follicular' THEN 1 "
       "WHEN 'Fertility' THEN 2 ELSE 3 END AS y, day_in_study FROM phase_panel", "phase_panel")
def label_encoding(spark, d):
    rows = lens.phase_panel(spark, d)
    return rows.select("participant_id", "day_in_study", public_label(F.col("phase")).alias("label"), class_index(F.col("phase")).alias("y"))


@query("SELECT c_custkey, (c_acctbal > 0)::INT + 1 AS kept FROM customer")
def pruned_maps(spark, d):
    entries = F.create_map(F.lit("name"), "c_name", F.lit("empty"), F.lit(""), F.lit("nan"), F.lit("NaN"), F.lit("balance"), F.when(F.col("c_acctbal") > 0, "x"))
    return table(spark, d, "customer").select("c_custkey", F.size(prune_map(entries)).alias("kept"))

