"""Registered queries of splits, smoothing and imputation in SQL's terms, lookups, previews, checks and cards."""

from __future__ import annotations

from pyspark.sql import functions as F

from daylark import session
from daylark.functions.scalar import cycle_day, cycle_day_from_anchor, sleep_minutes
from daylark.operators import impute, matching, metrics, panel, personal, profile, training
from daylark.plans import lens, modelling, relational
from daylark.plans.lens import r, rounded, table
from daylark.plans.relational import _PANEL, FEATURES, query
from daylark.sources import ingest

# ---- latest reports near a prediction

_REPORTS = """SELECT o_orderkey, o_custkey, o_orderdate::DATE AS report_date, max(l_quantity) FILTER (l_returnflag = 'A') AS lh,
  max(l_quantity) FILTER (l_returnflag = 'R' AND l_quantity > 25) AS e2 FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F' GROUP BY 1, 2, 3"""
_AWAY = "abs(epoch_ms(p.o_orderdate) - epoch_ms(f.report_date::TIMESTAMP))"


@query(f"""SELECT left_id, right_id, gap_ms, lh, e2 FROM (SELECT p.o_orderkey AS left_id, f.o_orderkey AS right_id, {_AWAY} AS gap_ms, f.lh, f.e2,
  row_number() OVER (PARTITION BY p.o_orderkey ORDER BY {_AWAY}, f.report_date DESC, f.o_orderkey) AS rank FROM (SELECT * FROM orders WHERE o_orderstatus = 'P') p
  JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY report_date DESC, o_orderkey) AS latest FROM ({_REPORTS})) f USING (o_custkey)
  WHERE latest <= 3 AND (f.lh IS NOT NULL OR f.e2 IS NOT NULL) AND {_AWAY} <= 60 * 86400 * 1000::BIGINT) WHERE rank = 1""")
def asof_report_60d(spark, d):
    """The nearest report with LH or E2 among each owner's latest reports (3 here, as owners have few; the default is 50)."""
    orders, items = table(spark, d, "orders"), table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    reports = orders.where("o_orderstatus = 'F'").join(items, "o_orderkey").groupBy("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("report_date")).agg(
        F.max(F.when(F.col("l_returnflag") == "A", F.col("l_quantity"))).alias("lh"),
        F.max(F.when((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 25), F.col("l_quantity"))).alias("e2"),
    )
    latest = matching.latest_per_owner(reports, "o_custkey", "report_date", "o_orderkey", most=3).where("lh is not null or e2 is not null")
    left = orders.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("left_id"), F.col("o_custkey").alias("owner"), F.col("o_orderdate").alias("at"))
    right = latest.select(F.col("o_orderkey").alias("right_id"), F.col("o_custkey").alias("owner"), F.col("report_date").alias("reported"))
    found = matching.nearest_within(left, right, "owner", "at", "reported").withColumn("gap_ms", F.floor(F.col("gap_us") / 1000))
    return found.join(latest.select(F.col("o_orderkey").alias("right_id"), "lh", "e2"), "right_id").select("left_id", "right_id", "gap_ms", "lh", "e2")


# ---- splits, smoothing, imputation

_RANKED = f"""SELECT participant_id, dominant, row_number() OVER (PARTITION BY dominant ORDER BY md5('42:' || participant_id), participant_id) - 1 AS rank,
  count(*) OVER (PARTITION BY dominant) AS size FROM ({relational.DOMINANT})"""
relational.oracle("split_assignment", f"""SELECT participant_id, dominant, CASE WHEN rank < floor(size * 0.15::DOUBLE + 0.5) THEN 'test'
  WHEN rank < 2 * floor(size * 0.15::DOUBLE + 0.5) THEN 'val' ELSE 'train' END AS split FROM ({_RANKED})""", "phase_panel")
relational.oracle("kfold_assignment", f"SELECT participant_id, dominant, (rank % 5)::INT AS fold FROM ({_RANKED})", "phase_panel")

_K = "[1, 2, 3, 4]"
_EMIT = ", ".join(
    f"ln(CASE WHEN (phase = '{p}') <> ((participant_id * 7 + day_in_study * 3) % 5 = 0) THEN 0.7::DOUBLE ELSE 0.1::DOUBLE END) - ln(q[{k + 1}])"
    for k, p in enumerate(modelling.PHASES)
)
_ORDER = "array_position(['Menstrual', 'Follicular', 'Fertility', 'Luteal'], {})"
_WAYS = f"list_transform({_K}, lambda i: v.s[i] + ln(v.m[i][j]))"
relational.oracle("viterbi_smooth", f"""SELECT participant_id, day_in_study, state::INT AS state FROM (
  SELECT participant_id, unnest(path) AS state, unnest(range(1, len(path) + 1)) AS t FROM (SELECT participant_id,
  paths[list_position(s, list_max(s))] AS path, row_number() OVER (PARTITION BY participant_id ORDER BY t DESC) AS last FROM v) WHERE last = 1)
  JOIN days USING (participant_id, t)""", "phase_panel", recursive=f"""mat AS (SELECT list(row ORDER BY a) AS m FROM (SELECT {_ORDER.format('"from"')} AS a,
  list(probability ORDER BY {_ORDER.format('"to"')}) AS row FROM ({modelling.transition_sql(exact=True)}) GROUP BY 1)),
  pri AS (SELECT list(probability ORDER BY {_ORDER.format('phase')}) AS q FROM ({modelling.prior_sql(exact=True)})),
  days AS (SELECT participant_id, day_in_study, row_number() OVER (PARTITION BY participant_id ORDER BY day_in_study) AS t, m, q, [{_EMIT}] AS e FROM phase_panel, mat, pri),
  v AS (SELECT participant_id, t, m, list_transform({_K}, lambda i: ln(q[i]) + e[i]) AS s, [[0], [1], [2], [3]] AS paths FROM days WHERE t = 1
  UNION ALL SELECT v.participant_id, d.t, v.m, list_transform({_K}, lambda j: list_max({_WAYS}) + d.e[j]),
  list_transform({_K}, lambda j: list_append(v.paths[list_position({_WAYS}, list_max({_WAYS}))], j - 1)) FROM v JOIN days d ON d.participant_id = v.participant_id AND d.t = v.t + 1)""")

_STATS = ", ".join(f"avg({c}) AS {c}_m, CASE WHEN stddev_samp({c}) <= 1e-9 OR stddev_samp({c}) IS NULL THEN 1.0 ELSE stddev_samp({c}) END AS {c}_s, quantile_cont({c}, 0.5) AS {c}_q" for c in FEATURES)
_Z = lambda side: ", ".join(f"({c} - coalesce({c}_m, 0)) / {c}_s AS z{k}" for k, c in enumerate(FEATURES))
_BOTH = " + ".join(f"(a.z{k} IS NOT NULL AND b.z{k} IS NOT NULL)::INT" for k in range(len(FEATURES)))
_GAP = " + ".join(f"coalesce((a.z{k} - b.z{k}) * (a.z{k} - b.z{k}), 0)" for k in range(len(FEATURES)))
_NEAR = ", ".join(f"min_by(b.{c}, key, 5) FILTER (b.{c} IS NOT NULL AND n > 0) AS near{k}" for k, c in enumerate(FEATURES))
_IMPUTED = f"""SELECT p.participant_id, p.day_in_study, {', '.join(f"coalesce(p.{c}, list_avg(near{k}), {c}_q)::DOUBLE AS {c}" for k, c in enumerate(FEATURES))}
  FROM panel p LEFT JOIN (SELECT participant_id, day_in_study, {_NEAR} FROM (SELECT a.participant_id, a.day_in_study, b, n,
  round(sqrt(gap / greatest(n, 1) * {len(FEATURES)}) * 1000000)::BIGINT * 2048 + b.ref AS key FROM (SELECT a, b, {_BOTH} AS n, {_GAP} AS gap FROM scaled a, refs b WHERE a.gaps))
  GROUP BY 1, 2) USING (participant_id, day_in_study), stats"""
_IMPUTE_CTES = f"""panel AS (SELECT participant_id, day_in_study, {', '.join(FEATURES)} FROM ({_PANEL})),
  stats AS (SELECT {_STATS} FROM panel WHERE {relational._SPLIT} = 'train'),
  scaled AS (SELECT panel.*, {_Z('a')}, {' OR '.join(f'{c} IS NULL' for c in FEATURES)} AS gaps FROM panel, stats),
  refs AS (SELECT *, row_number() OVER (ORDER BY md5(participant_id || ':' || day_in_study), participant_id, day_in_study) AS ref FROM scaled
  WHERE {relational._SPLIT} = 'train' QUALIFY ref <= 1200)"""
relational.oracle("knn_impute", f"SELECT participant_id, day_in_study, {', '.join(f'{r(c)} AS {c}' for c in FEATURES)} FROM ({_IMPUTED})", "phase_panel body", ctes=_IMPUTE_CTES)


def _imputed_some(spark, d, some):
    rows = rounded(relational.daily_features(spark, d).select("participant_id", "day_in_study", *FEATURES))
    filled = impute.knn_impute(rows, rows.where(relational.split_of() == "train"), ["participant_id", "day_in_study"], some)
    return rows, filled


_SOME = ("hrv_mean", "glucose_mean", "bmi")


@query()
def missingness_before_after(spark, d):
    """Per split the share of missing values before and after imputation, and its mean over the imputed features in percent."""
    rows, filled = _imputed_some(spark, d, _SOME)
    return rounded(profile.missingness_change(rows.withColumn("split", relational.split_of()), filled.withColumn("split", relational.split_of()), "split", _SOME))


relational.oracle("missingness_before_after", f"""SELECT split, {', '.join(f"{r(f'b_{c}')} AS {c}_before, 0.0::DOUBLE AS {c}_after" for c in _SOME)},
  {r('(100.0::DOUBLE * (' + ' + '.join(f'b_{c}' for c in _SOME) + f') / {len(_SOME)})')} AS mean_before, 0.0::DOUBLE AS mean_after FROM (SELECT split,
  {', '.join(f'avg(({c} IS NULL)::INT::DOUBLE) AS b_{c}' for c in _SOME)} FROM (SELECT *, {relational._SPLIT} AS split FROM ({_PANEL})) GROUP BY 1)""", "phase_panel body")


# ---- cards, importances, clusters

@query(f"""SELECT participant_id, {r('avg(mood)', 1)} AS mood, {r('avg(temperature)', 1)} AS temperature, {r('avg(cramps + fatigue)', 0)} AS load FROM (SELECT *,
  row_number() OVER (PARTITION BY participant_id ORDER BY day_in_study DESC) AS rank FROM diary) WHERE rank <= 7 GROUP BY 1""", "diary")
def week_cards(spark, d):
    """Means of the last seven days: two with one decimal, one whole."""
    rows = lens.diary(spark, d).withColumn("load", F.col("cramps") + F.col("fatigue"))
    return panel.week_cards(rows, {"mood": 1, "temperature": 1, "load": 0})


@query(f"""SELECT p_brand AS feature, {r('(gain / sum(gain) OVER ())', 4)} AS importance FROM (SELECT p_brand, sum(p_retailprice) AS gain FROM part GROUP BY 1)
  ORDER BY importance DESC, feature LIMIT 15""")
def importance_top15(spark, d):
    gains = table(spark, d, "part").groupBy(F.col("p_brand").alias("feature")).agg(F.sum("p_retailprice").alias("gain"))
    return training.importances(gains)


@query("SELECT k::INT AS cluster, count(cluster) AS n FROM range(4) AS c(k) LEFT JOIN (" + modelling.cluster_sql + ") ON cluster = k GROUP BY 1", "samples")
def cluster_sizes(spark, d):
    return training.cluster_sizes(modelling.cluster_assign(spark, d), 4)


# ---- checks, names, lookups

@query("""SELECT participant_id, day_in_study, cycle_day BETWEEN 1 AND 60 AS cycle_day_ok, coalesce(temperature BETWEEN 34 AND 40, true) AS temperature_ok,
  cycle_length BETWEEN 20 AND 45 AS cycle_length_ok, 8 + (participant_id * 7) % 14 BETWEEN 8 AND 18 AS luteal_length_ok FROM diary""", "diary")
def validation_flags(spark, d):
    rows = lens.diary(spark, d).withColumn("luteal_length", 8 + (F.col("participant_id") * 7) % 14)
    return personal.validated(rows).select("participant_id", "day_in_study", *(f"{c}_ok" for c in personal.LIMITS))


@query(f"""SELECT participant_id, day_in_study, {', '.join(f'{r(c)} AS {c}' for c in ('bmi', 'hrv_mean', 'glucose_mean', 'resp_rate_full'))}, {r('(CASE WHEN sleep_asleep_min <= 1440 THEN sleep_asleep_min ELSE sleep_asleep_min / 60 END)')} AS sleep_asleep_min FROM ({_PANEL})""", "phase_panel body")
def dashboard_to_features(spark, d):
    """Values under dashboard names, back to feature names; hours of sleep to minutes."""
    p = relational.daily_features(spark, d)
    shown = p.select(
        "participant_id", "day_in_study", "bmi", F.col("hrv_mean").alias("hrv"), F.col("glucose_mean").alias("glucose"),
        F.col("resp_rate_full").alias("respiratoryRate"), (F.col("sleep_asleep_min") / 60).alias("sleepDuration"),
    )
    return rounded(personal.to_features(shown).select("participant_id", "day_in_study", "bmi", "hrv_mean", "glucose_mean", "resp_rate_full", "sleep_asleep_min"))


@query("SELECT unnest(['" + "', '".join(personal.predictors()) + "']) AS feature")
def predictor_selection(spark, d):
    """The columns of the study's panel that are a model's inputs."""
    panel_columns = relational.study_panel(spark, d)
    chosen = panel_columns.select(*personal.predictors([c for c in panel_columns.columns if c in personal.FEATURE_KEYS]))
    return profile.feature_coverage(chosen, chosen.columns).select("feature")


@query("""SELECT o_orderkey AS id, o_totalprice AS local_value, c.value AS cloud_value FROM (SELECT * FROM orders WHERE o_orderstatus = 'P')
  LEFT JOIN (SELECT o_orderkey + 1 AS id, o_totalprice AS value FROM orders WHERE o_orderstatus <> 'P') c ON c.id = o_orderkey""")
def synced_lookup(spark, d):
    orders = table(spark, d, "orders")
    cloud = orders.where("o_orderstatus <> 'P'").select((F.col("o_orderkey") + 1).alias("id"), F.col("o_totalprice").alias("cloud_value"))
    return orders.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("local_value")).join(cloud, "id", "left")


@query(f"""SELECT p_type AS grp, p_brand AS key, coalesce(n, 0) AS non_null, {r('coalesce(share, 0.0)')} AS completeness FROM (SELECT DISTINCT p_type, p_brand FROM part)
  LEFT JOIN (SELECT p_brand AS b, count(CASE WHEN p_size > 25 THEN 1 END) AS n, count(CASE WHEN p_size > 25 THEN 1 END) / count(*)::DOUBLE AS share FROM part GROUP BY 1
  HAVING count(CASE WHEN p_size > 25 THEN 1 END) > 3) ON b = p_brand""")
def metadata_join(spark, d):
    """Definitions joined from the left with what is known of them."""
    parts = table(spark, d, "part")
    known = parts.groupBy(F.col("p_brand").alias("key")).agg(F.count_if(F.col("p_size") > 25).alias("non_null"), (F.count_if(F.col("p_size") > 25) / F.count(F.lit(1))).alias("completeness"))
    specs = parts.select(F.col("p_type").alias("grp"), F.col("p_brand").alias("key")).distinct()
    return rounded(profile.with_metadata(specs, known.where("non_null > 3"), "key", {"non_null": 0, "completeness": 0.0}))


@query("""SELECT coalesce(b.c_custkey, a.c_custkey) AS c_custkey, coalesce(b.v, a.v) AS v FROM (SELECT c_custkey, 'pool ' || c_name AS v FROM customer WHERE c_custkey % 3 <> 0) a
  FULL JOIN (SELECT c_custkey, 'test ' || c_name AS v FROM customer WHERE c_custkey % 3 <> 1) b USING (c_custkey)""")
def map_merge(spark, d):
    people = table(spark, d, "customer")
    side = lambda name, k: people.where(F.col("c_custkey") % 3 != k).select("c_custkey", F.concat(F.lit(name), "c_name").alias("v"))
    return matching.merged(side("pool ", 0), side("test ", 1), ["c_custkey"])


@query("SELECT participant_id, day_in_study, phase FROM phase_panel ORDER BY participant_id, day_in_study LIMIT 25", "phase_panel")
def preview_25(spark, d):
    return lens.phase_panel(spark, d).select("participant_id", "day_in_study", "phase").orderBy("participant_id", "day_in_study").limit(25)


@query("SELECT o_orderkey AS id, o_orderdate::DATE AS date, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def dated_entries(spark, d):
    entries = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("date"), "o_totalprice")
    return ingest.dated_entries(entries, table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("id")))


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey = 7")
def key_lookup(spark, d):
    return ingest.by_key(table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal"), "c_custkey", 7)


@query("""SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN json_extract_string(props, '$.k')::INT END AS k FROM events""")
def json_contract(spark, d):
    raw = F.when(F.col("event_id") % 4 == 0, F.lit("no json")).otherwise(F.col("props"))
    rows = ingest.extracted(table(spark, d, "events").select("event_id", raw.alias("raw")), "raw", "k int")
    return rows.select("event_id", "extracted.k")


@query("""SELECT participant_id, CASE WHEN participant_id % 3 = 0 THEN 'P' || participant_id ELSE 'OPTED-OUT' END AS alias, participant_id % 3 = 0 AS consent,
  count(*) FILTER (participant_id % 3 = 0) AS records FROM diary GROUP BY 1""", "diary")
def consent_envelope(spark, d):
    p = F.col("participant_id")
    return personal.envelopes(lens.diary(spark, d), "participant_id", F.concat(F.lit("P"), p.cast("string")), p % 3 == 0)


@query("""SELECT participant_id, count(*) AS days, string_agg(phase, ',' ORDER BY day_in_study) AS phases, count(mood) AS moods FROM diary GROUP BY 1""", "diary")
def day_sequences(spark, d):
    rows = panel.sequences(lens.diary(spark, d), ["phase", "mood"])
    moods = F.size(F.filter("rows.mood", lambda x: x.isNotNull())).cast("long")
    return rows.select("participant_id", F.size("rows").cast("long").alias("days"), F.array_join("rows.phase", ",").alias("phases"), moods.alias("moods"))


@query(f"""SELECT participant_id, day_in_study, (day_in_study - 1 + 5 * participant_id) % cycle_length + 1 AS cycle_day,
  (participant_id % 9 + day_in_study - 1) % cycle_length + 1 AS anchored, {r('(sleep_quality * 60)')} AS minutes FROM diary""", "diary")
def cycle_days(spark, d):
    rows, p = lens.diary(spark, d), F.col("participant_id")
    start = F.date_sub(F.lit("2024-01-01").cast("date"), 5 * p)
    anchored = cycle_day_from_anchor(p % 9 + 1, F.col("date"), F.lit("2024-01-01").cast("date") + F.lit(0), F.col("cycle_length"))
    day = cycle_day(F.col("date"), start, F.col("cycle_length"))
    minutes = sleep_minutes(F.col("sleep_quality"))
    return rounded(rows.select(p, "day_in_study", day.alias("cycle_day"), anchored.alias("anchored"), minutes.alias("minutes")))


@query(f"""SELECT count(*) AS n, {r('avg((quality = toxic)::INT::DOUBLE)', 4)} AS accuracy, {r('avg(-ln(greatest(1e-12, CASE WHEN quality = toxic THEN 0.8 ELSE 0.2 END)))', 4)} AS log_loss
  FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL""")
def overall_metrics(spark, d):
    """Accuracy and log loss of a guess with probability 0.8."""
    rows = table(spark, d, "labels").select("quality", "toxic").dropna()
    chance = F.when(F.col("quality") == F.col("toxic"), F.lit(0.8)).otherwise(F.lit(0.2))
    return metrics.overall(rows, "quality", "toxic", [0, 1], chance).select("n", "accuracy", "log_loss")


# ---- a strategy per feature, counts from file metadata

_MIXED = ("phase", "lh", "hrv_mean", "glucose_mean", "resp_rate_full", "bmi", "cramps", "fatigue")
_MIXED_PLAN = impute.plan(_MIXED)
_MEASURED, _SCALED = ("hrv_mean", "glucose_mean", "resp_rate_full", "bmi"), ("hrv_mean", "glucose_mean", "resp_rate_full", "bmi", "cramps")
_MIXED_PANEL = f"""panel AS (SELECT participant_id, day_in_study, s.phase, {', '.join(f'{r(c)} AS {c}' if c in _MEASURED else c for c in _MIXED[1:7])},
  'level ' || fatigue::INT AS fatigue FROM ({_PANEL}) p JOIN (SELECT participant_id, day_in_study, phase, lh, cramps, fatigue FROM selfreport) s USING (participant_id, day_in_study)),
  train AS (SELECT * FROM panel WHERE {relational._SPLIT} = 'train')"""
_AT = "md5(participant_id || ':' || day_in_study)"
_USUAL = {c: f"(SELECT {c} FROM train WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, min({_AT}) LIMIT 1)" for c in ("cramps", "fatigue")}


def _guarded(c):
    return f"(CASE WHEN count({c}) > 0 THEN CASE WHEN stddev_samp({c}) <= 1e-9 OR stddev_samp({c}) IS NULL THEN 1.0 ELSE stddev_samp({c}) END END)"


def _learned_sql(f):
    number = f.name in _SCALED
    fallback = {"continuous": r(f"quantile_cont({f.name}, 0.5)") + ", NULL", "categorical": f"{_USUAL.get(f.name)}, NULL" if number else f"NULL, {_USUAL.get(f.name)}"}.get(f.kind, "NULL, NULL")
    spread = f"{r(f'avg({f.name})')}, {r(_guarded(f.name))}" if number else "NULL, NULL"
    return f"SELECT '{f.name}', '{f.strategy}', {fallback}, {spread}, count({f.name}), count(*) - count({f.name}) FROM train"


def _mixed(spark, d):
    """Measured, ordinal (numbers and words), hormone and label columns in one table; stored, as statistics, reference and rows read it."""
    words = F.concat(F.lit("level "), F.col("fatigue").cast("int").cast("string")).alias("fatigue")
    return session.checkpointed(rounded(relational.study_panel(spark, d).select("participant_id", "day_in_study", *_MIXED[:-1], words)))


@query(f"""SELECT feature, strategy, fallback_number::DOUBLE AS fallback_number, fallback_word::VARCHAR AS fallback_word, mean::DOUBLE AS mean, std::DOUBLE AS std, train_non_null, train_missing
  FROM ({' UNION ALL '.join(map(_learned_sql, _MIXED_PLAN))}) AS t(feature, strategy, fallback_number, fallback_word, mean, std, train_non_null, train_missing)""",
       "phase_panel body selfreport", _MIXED_PANEL)
def imputation_statistics(spark, d):
    """What each feature's strategy learns from training rows."""
    found = impute.learned(_mixed(spark, d).where(relational.split_of() == "train"), ["participant_id", "day_in_study"], _MIXED_PLAN)
    number = F.col("fallback").try_cast("double")
    return rounded(found.select("feature", "strategy", number.alias("fallback_number"), F.when(number.isNull(), F.col("fallback")).alias("fallback_word"),
                                "mean", "std", "train_non_null", "train_missing"))


_SHARE = " + ".join(f"(a.z{k} IS NOT NULL AND b.z{k} IS NOT NULL)::INT" for k in range(len(_SCALED)))
_APART = " + ".join(f"coalesce((a.z{k} - b.z{k}) * (a.z{k} - b.z{k}), 0)" for k in range(len(_SCALED)))
_FILLED = (*_MEASURED, "cramps", "fatigue")
_TIMES = "list_transform({0}, lambda x: len(list_filter({0}, lambda y: y = x)))"
_OFTEN = lambda c: "near_{0}[list_position({1}, list_max({1}))]".format(c, _TIMES.format(f"near_{c}"))
_KEY = f"CASE WHEN n > 0 THEN round(sqrt(gap / greatest(n, 1) * {len(_FILLED)}) * 1000000)::BIGINT * 4294967296 ELSE 4000000000000000000 END + b.ref"


@query(f"""SELECT participant_id, day_in_study, phase, lh, {', '.join(r(f'coalesce(p.{c}, list_avg(near_{c}), {c}_q)') + f' AS {c}' for c in _MEASURED)},
  {', '.join(f'coalesce(p.{c}, {_OFTEN(c)}, {_USUAL[c]}) AS {c}' for c in ('cramps', 'fatigue'))} FROM panel p LEFT JOIN (
  SELECT participant_id, day_in_study, {', '.join(f'min_by(b.{c}, key, 5) FILTER (b.{c} IS NOT NULL) AS near_{c}' for c in _FILLED)} FROM (
  SELECT a.participant_id, a.day_in_study, b, {_KEY} AS key FROM (SELECT a, b, {_SHARE} AS n, {_APART} AS gap FROM scaled a, refs b WHERE a.gaps))
  GROUP BY 1, 2) USING (participant_id, day_in_study), stats""", "phase_panel body selfreport", f"""{_MIXED_PANEL},
  stats AS (SELECT {', '.join(f'avg({c}) AS {c}_m, {_guarded(c)} AS {c}_s, quantile_cont({c}, 0.5) AS {c}_q' for c in _SCALED)} FROM train),
  scaled AS (SELECT panel.*, {', '.join(f'({c} - {c}_m) / {c}_s AS z{k}' for k, c in enumerate(_SCALED))}, {' OR '.join(f'{c} IS NULL' for c in _FILLED)} AS gaps FROM panel, stats),
  refs AS (SELECT *, row_number() OVER (ORDER BY {_AT}, participant_id, day_in_study) AS ref FROM scaled WHERE {relational._SPLIT} = 'train')""")
def impute_by_strategy(spark, d):
    """Means and most frequent values of neighbours for measurements and ordinals; hormones and the label keep their gaps."""
    rows = _mixed(spark, d)
    return rounded(impute.impute(rows, rows.where(relational.split_of() == "train"), ["participant_id", "day_in_study"], _MIXED_PLAN))


#: The integer column of each given table whose span stands for the span of days.
_SPANS = {
    "region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey",
    "lineitem": "l_orderkey", "events": "event_id", "documents": None, "embeddings": None, "pages": None, "benchmark": None, "labels": None, "conversations": None,
}


@query(f"""SELECT coalesce(table_name, 'total') AS table_name, sum(n)::BIGINT AS n_rows, min(a)::BIGINT AS day_min, max(b)::BIGINT AS day_max, count(*) FILTER (n > 0) AS populated
  FROM ({' UNION ALL '.join(f"SELECT '{t}', count(*), {f'min({c}), max({c})' if c else 'NULL, NULL'} FROM {t}" for t, c in _SPANS.items())}) AS t(table_name, n, a, b)
  GROUP BY ROLLUP (table_name)""")
def metadata_overview(spark, d):
    """Rows and spans of every given table from file footers alone, and their totals."""
    return profile.footer_overview(spark, {t: (f"{d}/{t}.parquet", c) for t, c in _SPANS.items()})
