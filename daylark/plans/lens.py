"""Study-shaped views of the test tables, as DataFrames and as DuckDB common table expressions.

The study's files are not public, so queries run on these: events stand for sensor samples, customers
for the body table, orders for predictions and lab reports, line items for assays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daylark.functions.scalar import half_up, phase_of, training_label

STREAMS = {"click": "hrv", "view": "glucose", "purchase": "sleep", "signup": "respiratory", "error": "wrist"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    stream = F.create_map(*[F.lit(x) for kv in STREAMS.items() for x in kv])[F.col("event_type")]
    return e.select(
        F.col("user_id").cast("int").alias("participant_id"),
        (F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) + 1).alias("day_in_study"),
        stream.alias("stream"), "value", "event_id",
        (F.get_json_object("props", "$.k").cast("double") / 100).alias("coverage"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp_local"),
    )


def spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).select("participant_id", "day_in_study").distinct()


def phase_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spine with a cycle per participant and a phase per day, under the training labels."""
    p = F.col("participant_id")
    cycle = spine(spark, sf_dir).withColumns({"cycle_length": 20 + p % 26, "luteal_length": 8 + (p * 7) % 11})
    day = cycle.withColumn("cycle_day", (F.col("day_in_study") - 1 + 5 * p) % F.col("cycle_length") + 1)
    return day.withColumn("phase", training_label(phase_of(F.col("cycle_day"), F.col("cycle_length"), F.col("luteal_length"))))


def diary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Self-reports of each day of the panel, under the public labels, with gaps."""
    p, d = F.col("participant_id"), F.col("day_in_study")
    gaps = lambda value, k, at: F.when((p + k * d) % 7 != at, value)
    return phase_panel(spark, sf_dir).select(
        p, d, F.date_add(F.lit("2024-01-01").cast("date"), d - 1).alias("date"),
        F.when(F.col("phase") == "Fertility", "Ovulatory").otherwise(F.col("phase")).alias("phase"),
        "cycle_day", "cycle_length",
        gaps(((p * 3 + d * 7) % 9 + 1).cast("double"), 1, 0).alias("mood"),
        gaps(((p * 5 + d * 3) % 10).cast("double"), 2, 1).alias("sleep_quality"),
        gaps(36 + ((p + d) % 13) / 10.0, 3, 2).alias("temperature"),
        ((p * d) % 11).cast("double").alias("cramps"), ((p + 2 * d) % 10).cast("double").alias("fatigue"),
        ((2 * p + d) % 9).cast("double").alias("headache"), ((p * 11 + d * 13) % 120).cast("double").alias("lh"),
        F.concat(F.lit("note "), d.cast("string")).alias("notes"),
    )


#: Self-reported columns: value (participant * a + day * b) mod m, missing where (participant + c * day) mod 7 is 3.
SELF_REPORTS = {
    "lh": (11, 13, 120, 1), "estrogen": (7, 17, 300, 2), "pdg": (5, 3, 20, 3), "cramps": (1, 4, 6, 4), "bloating": (2, 3, 6, 5),
    "fatigue": (3, 2, 6, 6), "headaches": (4, 1, 6, 1), "sorebreasts": (5, 2, 6, 2), "moodswing": (3, 5, 6, 3), "stress": (2, 5, 6, 4),
    "sleepissue": (1, 5, 6, 5),
}


def selfreport(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel's days with hormones and ordinal self-reports, with gaps."""
    p, d = F.col("participant_id"), F.col("day_in_study")
    values = [F.when((p + c * d) % 7 != 3, (p * a + d * b) % m).cast("double").alias(n) for n, (a, b, m, c) in SELF_REPORTS.items()]
    return phase_panel(spark, sf_dir).select("participant_id", "day_in_study", "phase", *values)


def body(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Body surveys of the customers, each missing for some."""
    k, a = F.col("c_custkey"), F.abs("c_acctbal")
    return table(spark, sf_dir, "customer").select(
        k.cast("int").alias("participant_id"),
        F.when(k % 2 == 0, 150 + k % 40).cast("double").alias("height_2022"), F.when(k % 3 != 0, 45 + a % 50).alias("weight_2022"),
        F.when(k % 5 == 0, 151 + k % 40).cast("double").alias("height_2024"), F.when(k % 4 == 0, 46 + a % 50).alias("weight_2024"),
    )


def of_stream(spark: SparkSession, sf_dir: str, stream: str) -> DataFrame:
    return samples(spark, sf_dir).where(F.col("stream") == stream)


def hrv(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return of_stream(spark, sf_dir, "hrv").select(
        "participant_id", "day_in_study", v.alias("rmssd"), "coverage", (v * 2).alias("low_frequency"), (v * 3).alias("high_frequency")
    )


def sleep(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, k = F.col("value"), F.floor(F.col("coverage") * 100 + 0.5).cast("int")
    text = lambda x: x.cast("string")
    levels = F.concat(
        F.lit('{"summary": {"deep": {"minutes": '), text(k), F.lit('}, "rem": {"minutes": '), text(k + 7), F.lit('}, "light": {"minutes": '),
        text(k * 2), F.lit("}}}"),
    )
    return of_stream(spark, sf_dir, "sleep").select(
        "participant_id", "day_in_study", (v * 10).alias("minutes_asleep"), v.alias("minutes_awake"), (v * 11).alias("time_in_bed"),
        (80 + v / 10).alias("efficiency"), F.col("timestamp_local").alias("sleep_start_timestamp"),
        F.col("timestamp_local").alias("sleep_end_timestamp"), F.when(k % 10 == 3, F.lit("not json")).otherwise(levels).alias("levels"),
    )


def scaled(spark: SparkSession, sf_dir: str, stream: str, columns: dict[str, str]) -> DataFrame:
    """A stream whose value, times 1, 2, 3..., stands for the given input columns."""
    rows = of_stream(spark, sf_dir, stream)
    return rows.select("participant_id", "day_in_study", *[(F.col("value") * (k + 1)).alias(c) for k, c in enumerate(columns.values())])


def glucose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return of_stream(spark, sf_dir, "glucose").select("participant_id", "day_in_study", F.col("value").alias("glucose_value"))


def wrist(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = of_stream(spark, sf_dir, "wrist")
    return rows.select("participant_id", "day_in_study", (F.col("value") / 10 - 2).alias("temperature_diff_from_baseline"))


def rounded(rows: DataFrame, digits: int = 6) -> DataFrame:
    """All doubles rounded half up, so that sums in another order give the same row."""
    return rows.select(*[half_up(F.col(c), digits).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes])


def as_int(c: str) -> Column:
    return F.col(c).cast("int")


def r(x: str, digits: int = 6) -> str:
    """The SQL of ``half_up``."""
    k = f"{10**digits}.0::DOUBLE"
    return f"(sign({x})*floor(abs({x})*{k}+0.5)/{k}+0.0)"


_CASES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STREAMS.items())
CTES = {
    "samples": f"""SELECT user_id::INT AS participant_id, (date_diff('day', DATE '2024-01-01', ts::DATE) + 1)::INT AS day_in_study,
      CASE event_type {_CASES} END AS stream, value, event_id, json_extract_string(props, '$.k')::DOUBLE / 100 AS coverage,
      strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp_local FROM events""",
    "spine": "SELECT DISTINCT participant_id, day_in_study FROM samples",
    "phase_panel": """SELECT *, CASE WHEN cycle_day <= 5 THEN 'Menstrual' WHEN cycle_day < cycle_length - luteal_length - 1 THEN 'Follicular'
      WHEN cycle_day <= cycle_length - luteal_length + 1 THEN 'Fertility' ELSE 'Luteal' END AS phase
      FROM (SELECT *, (day_in_study - 1 + 5 * participant_id) % cycle_length + 1 AS cycle_day
        FROM (SELECT *, 20 + participant_id % 26 AS cycle_length, 8 + (participant_id * 7) % 11 AS luteal_length FROM spine))""",
    "diary": """SELECT participant_id, day_in_study, DATE '2024-01-01' + (day_in_study - 1) AS date,
      CASE WHEN phase = 'Fertility' THEN 'Ovulatory' ELSE phase END AS phase, cycle_day, cycle_length,
      CASE WHEN (participant_id + day_in_study) % 7 <> 0 THEN ((participant_id * 3 + day_in_study * 7) % 9 + 1)::DOUBLE END AS mood,
      CASE WHEN (participant_id + 2 * day_in_study) % 7 <> 1 THEN ((participant_id * 5 + day_in_study * 3) % 10)::DOUBLE END AS sleep_quality,
      CASE WHEN (participant_id + 3 * day_in_study) % 7 <> 2 THEN 36 + ((participant_id + day_in_study) % 13) / 10.0::DOUBLE END AS temperature,
      ((participant_id * day_in_study) % 11)::DOUBLE AS cramps, ((participant_id + 2 * day_in_study) % 10)::DOUBLE AS fatigue,
      ((2 * participant_id + day_in_study) % 9)::DOUBLE AS headache, ((participant_id * 11 + day_in_study * 13) % 120)::DOUBLE AS lh,
      'note ' || day_in_study AS notes FROM phase_panel""",
    "selfreport": "SELECT participant_id, day_in_study, phase, " + ", ".join(
        f"CASE WHEN (participant_id + {c} * day_in_study) % 7 <> 3 THEN ((participant_id * {a} + day_in_study * {b}) % {m})::DOUBLE END AS {n}"
        for n, (a, b, m, c) in SELF_REPORTS.items()) + " FROM phase_panel",
    "body": """SELECT c_custkey::INT AS participant_id, CASE WHEN c_custkey % 2 = 0 THEN (150 + c_custkey % 40)::DOUBLE END AS height_2022,
      CASE WHEN c_custkey % 3 <> 0 THEN 45 + abs(c_acctbal) % 50 END AS weight_2022,
      CASE WHEN c_custkey % 5 = 0 THEN (151 + c_custkey % 40)::DOUBLE END AS height_2024,
      CASE WHEN c_custkey % 4 = 0 THEN 46 + abs(c_acctbal) % 50 END AS weight_2024 FROM customer""",
}
_NEEDS = {"spine": ["samples"], "phase_panel": ["samples", "spine"], "diary": ["samples", "spine", "phase_panel"], "selfreport": ["samples", "spine", "phase_panel"]}


def sql(needs: str, query: str, ctes: str = "", recursive: str = "") -> str:
    """``query`` after the common table expressions it needs, and further ones given as text."""
    names = [n for n in CTES if any(n == x or n in _NEEDS.get(x, []) for x in needs.split())]
    parts = [*(f"{n} AS ({CTES[n]})" for n in names), *filter(None, (ctes, recursive))]
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n" + query if parts else query
