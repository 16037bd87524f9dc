"""Queries of splits, imputation, models and evaluation over the study-shaped views."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from daylark.functions import crypto
from daylark.functions.scalar import PHASES, half_up
from daylark.operators import impute, metrics, panel, personal, profile, ridge, smoothing, splits, training
from daylark.operators.boosting import Boosting
from daylark.plans import lens, relational
from daylark.plans.lens import r, rounded, table
from daylark.plans.relational import FEATURES, query
from daylark.session import checkpointed

PREDICTORS = ("hrv_mean", "glucose_mean", "sleep_efficiency", "wrist_temp_daily_mean", "mood", "temperature", "lh", "cycle_day")
#: Small model sizes of the experts; the other queries have the operators' defaults, which are the study's.
CLASSIFIER_SIZES = {"rounds": 4, "trees": 5, "iterations": 10}


def study_rows(spark, d):
    """Daily features with self-reports and the training label."""
    extra = lens.diary(spark, d).select("participant_id", "day_in_study", "mood", "temperature", "lh")
    return relational.daily_features(spark, d).join(extra, ["participant_id", "day_in_study"])


def people(spark, d):
    return profile.dominant_phase(profile.phase_counts(lens.phase_panel(spark, d))).select("participant_id", "dominant")


@query()
def split_assignment(spark, d):
    return splits.stratified_split(people(spark, d), "participant_id", "dominant")


@query()
def kfold_assignment(spark, d):
    return splits.stratified_folds(people(spark, d), "participant_id", "dominant")


@query()
def knn_impute(spark, d):
    # rounded, as sums in another order would else change distances; written, as statistics, reference and rows all read it, and
    # not cached: a cache is found again by the path, also when other tables lie there since
    rows = checkpointed(rounded(relational.daily_features(spark, d).select("participant_id", "day_in_study", *FEATURES)))
    return rounded(impute.knn_impute(rows, rows.where(relational.split_of() == "train"), ["participant_id", "day_in_study"], FEATURES))


_MEANS = ("hrv_mean", "glucose_mean", "sleep_efficiency")


@query(f"""SELECT participant_id, {', '.join(r(f'coalesce(o.{c}, a.{c})') + f' AS {c}' for c in _MEANS)} FROM (SELECT participant_id,
  {', '.join(f'avg({c}) AS {c}' for c in _MEANS)} FROM ({relational._PANEL}) GROUP BY 1) o CROSS JOIN (SELECT {', '.join(f'avg({c}) AS {c}' for c in _MEANS)}
  FROM ({relational._PANEL})) a""", "phase_panel body")
def participant_embeddings(spark, d):
    rows = rounded(relational.daily_features(spark, d))
    return rounded(training.participant_embeddings(rows, _MEANS))


_CENTRES = {0: (10.0, 10.0), 1: (30.0, 20.0), 2: (60.0, 60.0)}
_FAR = [f"(hrv_mean - {a}) * (hrv_mean - {a}) + (glucose_mean - {b}) * (glucose_mean - {b})" for a, b in _CENTRES.values()]


cluster_sql = f"""SELECT participant_id, CASE least(d0, d1, d2) WHEN d0 THEN 0 WHEN d1 THEN 1 ELSE 2 END AS cluster, {r('least(d0, d1, d2)', 3)} AS distance
  FROM (SELECT participant_id, {', '.join(f'{x} AS d{k}' for k, x in enumerate(_FAR))} FROM (
  SELECT participant_id, {r('avg(value) FILTER (stream = $$hrv$$)')} AS hrv_mean, {r('avg(value) FILTER (stream = $$glucose$$)')} AS glucose_mean FROM samples GROUP BY 1)
  WHERE hrv_mean IS NOT NULL AND glucose_mean IS NOT NULL)"""


@query(cluster_sql, "samples")
def cluster_assign(spark, d):
    of = lambda s: half_up(F.avg(F.when(F.col("stream") == s, F.col("value"))), 6)
    means = lens.samples(spark, d).groupBy("participant_id").agg(of("hrv").alias("hrv_mean"), of("glucose").alias("glucose_mean")).dropna()
    found = training.nearest_centroid(means, ("hrv_mean", "glucose_mean"), _CENTRES)
    return found.select("participant_id", "cluster", half_up(F.col("distance"), 3).alias("distance"))


@query()
def kmeans_phenotypes(spark, d):
    return training.phenotypes(training.participant_embeddings(relational.daily_features(spark, d), _MEANS), _MEANS)


_GRID = f"(SELECT a.phase AS \"from\", b.phase AS \"to\" FROM {relational._CLASSES} a CROSS JOIN {relational._CLASSES} b)"


def transition_sql(exact: bool = False) -> str:
    share = '((coalesce(n, 0) + 1) / sum(coalesce(n, 0) + 1) OVER (PARTITION BY "from")::DOUBLE)'
    return f"""SELECT "from", "to", coalesce(n, 0) AS n, {share if exact else r(share)} AS probability
      FROM {_GRID} LEFT JOIN (SELECT phase AS "from", next AS "to", count(*) AS n FROM (SELECT phase, lead(phase) OVER (PARTITION BY participant_id
      ORDER BY day_in_study) AS next FROM phase_panel) WHERE next IS NOT NULL GROUP BY 1, 2) USING ("from", "to")"""


def prior_sql(exact: bool = False) -> str:
    share = "((coalesce(n, 0) + 1) / sum(coalesce(n, 0) + 1) OVER ()::DOUBLE)"
    return f"""SELECT phase, coalesce(n, 0) AS n, {share if exact else r(share)} AS probability FROM {relational._CLASSES}
      LEFT JOIN (SELECT phase, count(*) AS n FROM phase_panel GROUP BY 1) USING (phase)"""


@query(transition_sql(), "phase_panel")
def hmm_transition(spark, d):
    return rounded(panel.transition_matrix(lens.phase_panel(spark, d)))


@query(prior_sql(), "phase_panel")
def hmm_prior(spark, d):
    return rounded(panel.prior(lens.phase_panel(spark, d)))


@query()
def viterbi_smooth(spark, d):
    rows = lens.phase_panel(spark, d)
    transition, first = np.zeros((4, 4)), np.zeros(4)
    for t in panel.transition_matrix(rows).collect():
        transition[PHASES.index(t["from"]), PHASES.index(t["to"])] = t["probability"]
    for t in panel.prior(rows).collect():
        first[PHASES.index(t["phase"])] = t["probability"]
    noisy = (F.col("participant_id") * 7 + F.col("day_in_study") * 3) % 5 == 0
    chance = [F.when((F.col("phase") == p) != noisy, F.lit(0.7)).otherwise(F.lit(0.1)).alias(f"p{k}") for k, p in enumerate(PHASES)]
    return smoothing.smooth(rows.select("participant_id", "day_in_study", *chance), [f"p{k}" for k in range(4)], transition, first)


_CONF = """SELECT a.c AS truth, b.c AS predicted, coalesce(n, 0) AS n FROM (SELECT unnest([0, 1]) AS c) a CROSS JOIN (SELECT unnest([0, 1]) AS c) b
  LEFT JOIN (SELECT quality AS t, toxic AS p, count(*) AS n FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY 1, 2) ON a.c = t AND b.c = p"""


@query(f"SELECT truth, predicted, n, {r('(n / nullif(sum(n) OVER (PARTITION BY truth), 0)::DOUBLE)')} AS share FROM ({_CONF})")
def confusion_matrix(spark, d):
    return rounded(metrics.confusion(table(spark, d, "labels").select("quality", "toxic").dropna(), "quality", "toxic", [0, 1]))


@query(f"""SELECT c AS class, support::BIGINT AS support, {r('p', 4)} AS precision, {r('q', 4)} AS recall,
  {r('(CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0.0 END)', 4)} AS f1 FROM (SELECT c, support, coalesce(tp / nullif(claimed, 0)::DOUBLE, 0.0) AS p,
  coalesce(tp / nullif(support, 0)::DOUBLE, 0.0) AS q FROM (SELECT truth AS c, sum(n) FILTER (truth = predicted) AS tp, sum(n) AS support FROM ({_CONF}) GROUP BY 1)
  JOIN (SELECT predicted AS c, sum(n) AS claimed FROM ({_CONF}) GROUP BY 1) USING (c))""")
def class_metrics(spark, d):
    return metrics.class_report(metrics.confusion(table(spark, d, "labels").select("quality", "toxic").dropna(), "quality", "toxic", [0, 1]))


_E = "(l_extendedprice - l_quantity * 1500)"


@query(f"""SELECT l_returnflag, count(*) AS n, {r(f'avg(abs({_E}))', 4)} AS mae, {r(f'sqrt(avg({_E} * {_E}))', 4)} AS rmse,
  {r(f'(1 - sum({_E} * {_E}) / (var_pop(l_extendedprice) * count(*)))', 4)} AS r2 FROM lineitem GROUP BY 1""")
def regression_metrics(spark, d):
    rows = table(spark, d, "lineitem").withColumn("guess", F.col("l_quantity") * 1500)
    return metrics.regression_report(rows, "l_extendedprice", "guess", ["l_returnflag"])


@query(f"""SELECT l_linestatus, {r('avg(a)', 4)} AS hit_mean, {r('stddev_pop(a)', 4)} AS hit_std FROM (SELECT l_linestatus, l_linenumber, avg((l_returnflag = 'N')::INT) AS a
  FROM lineitem GROUP BY 1, 2) GROUP BY 1""")
def cv_mean_std(spark, d):
    folds = table(spark, d, "lineitem").groupBy("l_linestatus", "l_linenumber").agg(F.avg((F.col("l_returnflag") == "N").cast("double")).alias("hit"))
    return metrics.over_folds(folds, ["l_linestatus"], ["hit"])


HORMONES = ("lh", "estrogen", "pdg")


def split_panel(spark, d):
    """The whole panel with each row's split, and its fold in the pool of train and val, looked up in the stored assignments; written once."""
    found = checkpointed(splits.stratified_split(people(spark, d), "participant_id", "dominant"))
    folds = splits.stratified_folds(found.where("split <> 'test'"), "participant_id", "dominant").select("participant_id", "fold")
    assigned = checkpointed(found.select("participant_id", "split").join(folds, "participant_id", "left"))
    return checkpointed(relational.study_panel(spark, d).join(assigned, "participant_id")), assigned


@query()
def hormone_regression_metrics(spark, d):
    """Three hormones by three methods of the study's sizes, from all predictors but the hormones."""
    rows, _ = split_panel(spark, d)
    return training.hormone_models(rows.drop("fold"), "split", HORMONES, [p for p in personal.predictors() if p not in HORMONES])[0]


@query()
def phase_cv_metrics(spark, d):
    """Five folds of the pool by three methods of the operators' default sizes, from all predictors; the splits and folds are the stored ones."""
    rows, assigned = split_panel(spark, d)
    pool = rows.where("split <> 'test'").drop("fold")
    return training.cross_validate(pool, assigned, personal.predictors(), ["boosting", "forest", "logistic"], 5)


@query()
def benchmark_leaderboard(spark, d):
    folds = splits.stratified_folds(people(spark, d), "participant_id", "dominant", 2)
    study = checkpointed(study_rows(spark, d))  # the rolling values are joined to the panel that they are made of
    rows = panel.rolling_last_observed(study, "hrv_mean").withColumnsRenamed({"mean": "hrv_rolling", "std": "hrv_spread"})
    predictors = [*PREDICTORS, "hrv_rolling", "hrv_spread"]
    rows, folds = checkpointed(rows), checkpointed(folds)  # read by every fold and method
    plain = training.cross_validate(rows, folds, predictors, ["ridge", "forest", "perceptron"], 2)
    boosted = training.out_of_fold(rows, folds, predictors, "boosting", 2)
    smooth = training.smoothed(boosted, rows, folds, 2)
    return training.leaderboard(plain.unionByName(training.by_fold(boosted, "boosting")).unionByName(training.by_fold(smooth, "smoothed boosting")))


_SIGNS = ("cycle_day", "cycle_length", "cramps", "fatigue", "headache", "lh")
_SIGN_ROWS = f"(SELECT row_number() OVER () AS i, phase, {', '.join(f'{c}::DOUBLE AS {c}' for c in _SIGNS)} FROM diary)"
_CUTS = f"""cuts AS (SELECT DISTINCT feature, v[floor(i / 25.0::DOUBLE * len(v))::INT + 1] AS cut FROM
  (SELECT feature, list(value ORDER BY value) AS v FROM (UNPIVOT (SELECT {', '.join(f'{c}::DOUBLE AS {c}' for c in _SIGNS)} FROM diary) ON {', '.join(_SIGNS)} INTO NAME feature VALUE value) GROUP BY 1), range(1, 25) AS r(i))"""


def _gain_sql(gradients: str, key: str, others: str = "true") -> str:
    """The best cut of all rows for the gradients (key, i, g): one row per key."""
    return f"""SELECT * EXCLUDE rank FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY gain DESC) AS rank FROM (
      SELECT {key}, feature, cut, ls * ls / (ln + 1) + (s - ls) * (s - ls) / (n - ln + 1) - s * s / (n + 1) AS gain, ls / (ln + 1) AS low, (s - ls) / (n - ln + 1) AS high FROM (
        SELECT {key}, feature, cut, count(*) AS n, count(*) FILTER (value <= cut) AS ln, sum(g) AS s, coalesce(sum(g) FILTER (value <= cut), 0) AS ls
        FROM ({gradients}) JOIN long USING (i) JOIN cuts USING (feature) WHERE {others} GROUP BY ALL) WHERE ln > 0 AND ln < n)) WHERE rank = 1"""


_LONG = f"long AS (UNPIVOT {_SIGN_ROWS} ON {', '.join(_SIGNS)} INTO NAME feature VALUE value)"
_CLASS_GRADIENTS = f"""SELECT c.phase AS class, i, ((r.phase = c.phase)::INT - (c.n + 1) / (c.total + 4)::DOUBLE) * (r.total / (4 * r.n)::DOUBLE) AS g
  FROM (SELECT * FROM {_SIGN_ROWS} JOIN sizes USING (phase)) r, sizes c"""
_SIZES = "sizes AS (SELECT phase, count(*) AS n, sum(count(*)) OVER () AS total FROM diary GROUP BY 1)"


def _signs(spark, d):
    """Self-reports without gaps as a feature vector, with the class and its weight."""
    rows = lens.diary(spark, d).withColumn("phase", F.when(F.col("phase") == "Ovulatory", "Fertility").otherwise(F.col("phase")))
    return VectorAssembler(inputCols=list(_SIGNS), outputCol="features").transform(training.labelled(rows))


@query(f"""SELECT CASE WHEN class = 'Ovulatory' THEN 'Fertility' ELSE class END AS class, feature, {r('cut')} AS threshold, {r('gain', 3)} AS gain, {r('low')} AS low, {r('high')} AS high
  FROM ({_gain_sql(_CLASS_GRADIENTS, 'class')})""", "diary", ", ".join((_CUTS, _LONG, _SIZES)))
def boosting_first_splits(spark, d):
    """First cut of each class's tree in softmax boosting, its gain and leaves."""
    own = Boosting(len(PHASES), rounds=1, depth=1, rate=1.0, least=2).fit(_signs(spark, d)).content["rounds"][0]
    return rounded(_stumps(spark, own, list(PHASES), "class"))


def _stumps(spark, trees, names, key):
    rows = [(name, _SIGNS[t["feature"][0]], float(t["threshold"][0]), float(t["gain"][0]), *map(float, t["value"][1:3])) for name, t in zip(names, trees)]
    found = spark.createDataFrame(rows, f"{key} string, feature string, threshold double, gain double, low double, high double")
    return found.withColumn("gain", half_up(F.col("gain"), 3))


_TARGETS = ("lh", "fatigue", "headache")
_TARGET_GRADIENTS = " UNION ALL ".join(f"SELECT '{t}' AS target, i, {t} - avg({t}) OVER () AS g FROM {_SIGN_ROWS}" for t in _TARGETS)


@query(f"""SELECT target, feature, {r('cut')} AS threshold, {r('gain', 3)} AS gain, {r('low')} AS low, {r('high')} AS high
  FROM ({_gain_sql(_TARGET_GRADIENTS, 'target', 'feature <> target')})""", "diary", ", ".join((_CUTS, _LONG)))
def boosting_regression_splits(spark, d):
    """First cut of penalised regression boosting per target, from the other signs."""
    trees = []
    for target in _TARGETS:
        others = [c for c in _SIGNS if c != target]
        rows = VectorAssembler(inputCols=others, outputCol="features").transform(lens.diary(spark, d))
        tree = Boosting(rounds=1, depth=1, rate=1.0, least=2).setLabelCol(target).fit(rows).content["rounds"][0][0]
        trees.append(tree | {"feature": [_SIGNS.index(others[tree["feature"][0]])]})
    return rounded(_stumps(spark, trees, _TARGETS, "target"))


@query(f"""SELECT feature, {r('coalesce(gain, 0) / sum(gain) OVER ()', 4)} AS importance FROM (SELECT unnest([{', '.join(f"'{c}'" for c in _SIGNS)}]) AS feature)
  LEFT JOIN (SELECT feature, sum(gain) AS gain FROM ({_gain_sql(_CLASS_GRADIENTS, 'class')}) GROUP BY 1) USING (feature) ORDER BY 2 DESC, 1 LIMIT 15""",
       "diary", ", ".join((_CUTS, _LONG, _SIZES)))
def boosting_importance_top15(spark, d):
    """Shares of the gain of a fitted softmax boosting, largest first."""
    model = Boosting(len(PHASES), rounds=1, depth=1, rate=1.0, least=2).fit(_signs(spark, d))
    return training.importances(spark.createDataFrame(list(zip(_SIGNS, model.importance)), "feature string, gain double"))


_PLACES = list(enumerate(("1.0", *_SIGNS)))


@query(" UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, {r(f'sum({a}::DOUBLE * {b}::DOUBLE)', 3)} AS value FROM diary" for i, a in _PLACES for j, b in _PLACES), "diary")
def ridge_gram(spark, d):
    """Sums of products that the ridge of all classes is solved from, in one scan."""
    rows = lens.diary(spark, d).select(F.array(F.lit(1.0), *[F.col(c).cast("double") for c in _SIGNS]).alias("z"))
    return ridge.gram(rows, "z").select(F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), half_up(F.col("value"), 3).alias("value"))


def _fitted(spark, d):
    rows = training.labelled(checkpointed(study_rows(spark, d).withColumn("split", relational.split_of())))
    train = rows.where("split = 'train'")
    design = training.Design(train, PREDICTORS)
    return rows, train, design


@query()
def predict_phase(spark, d):
    rows, train, design = _fitted(spark, d)
    model = training.classifiers(len(PREDICTORS))["forest"]().fit(design(train))
    _, hormones = training.hormone_models(rows, "split", ["lh"], [p for p in PREDICTORS if p != "lh"])
    unknown = rows.where("split = 'test'").withColumn("lh", F.when(F.col("day_in_study") % 2 == 0, F.col("lh")))
    found = training.predict_phase(unknown, design, model, hormones)
    return found.select("participant_id", "day_in_study", "phase_predicted", F.array_join("imputed", ",").alias("imputed"))


@query()
def moe_dispatch(spark, d):
    rows, train, design = _fitted(spark, d)
    clusters = training.phenotypes(training.participant_embeddings(rows, _MEANS), _MEANS)
    joined = design(rows.join(clusters, "participant_id", "left")).cache()
    make = training.classifiers(len(PREDICTORS), **CLASSIFIER_SIZES)["forest"]
    models = training.experts(joined.where("split = 'train'"), "cluster", make)
    out = training.dispatch(joined.where("split = 'test'"), "cluster", models)
    return out.select("participant_id", "day_in_study", "expert", F.col("prediction").cast("int").alias("prediction"))


@query("SELECT c_custkey, c_name AS name, NULL::VARCHAR AS wrong_secret FROM customer")
def pii_roundtrip(spark, d):
    wire = crypto.encrypt(F.col("c_name"), "a secret")
    rows = table(spark, d, "customer").select("c_custkey", wire.alias("wire"))
    return rows.select("c_custkey", crypto.decrypt(F.col("wire"), "a secret").alias("name"), crypto.decrypt(F.col("wire"), "another").alias("wrong_secret"))
