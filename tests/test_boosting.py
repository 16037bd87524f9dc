"""Histogram boosting against a plain re-computation, deals of rows, saving."""

import math

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from daylark.operators import profile
from daylark.operators.boosting import Boosting, BoostingModel, best_split


def frame(spark, x, y, w=None, parts=2):
    rows = [(Vectors.dense(a), float(b), float(c)) for a, b, c in zip(x.tolist(), y, w if w is not None else np.ones(len(y)))]
    return spark.createDataFrame(rows, ["features", "label", "weight"]).repartition(parts)


def thresholds(values, k):
    """Candidate cuts at floor(i / (k + 1) * n) of the sorted values."""
    values = sorted(values)
    return sorted({values[math.floor(i / (k + 1) * len(values))] for i in range(1, k + 1)})


def grow(x, g, cuts, depth, least, penalty, at, gains):
    """A tree by looking at every cut of every feature; rows that end in a leaf get its value in ``at``."""

    def node(rows, level):
        value = g[rows].sum() / (len(rows) + penalty)
        best = (1e-12, None, None)
        if level < depth and len(rows) >= least:
            for f in range(x.shape[1]):
                for c in cuts[f]:
                    left = rows[x[rows, f] <= c]
                    right = rows[x[rows, f] > c]
                    if len(left) and len(right):
                        gain = g[left].sum() ** 2 / (len(left) + penalty) + g[right].sum() ** 2 / (len(right) + penalty) - g[rows].sum() ** 2 / (len(rows) + penalty)
                        if gain > best[0] + 1e-9:
                            best = (gain, f, c)
        if best[1] is None:
            at[rows] = value
            return
        gains[best[1]] += best[0]
        node(rows[x[rows, best[1]] <= best[2]], level + 1)
        node(rows[x[rows, best[1]] > best[2]], level + 1)

    node(np.arange(len(x)), 0)


def plain_fit(x, y, w, classes, rounds, depth, rate, least, cuts, penalty):
    n, gains = len(y), np.zeros(x.shape[1])
    edges = [thresholds(x[:, f], cuts) for f in range(x.shape[1])]
    if classes:
        scores = np.tile(np.log([(np.sum(y == k) + 1) / (n + classes) for k in range(classes)]), (n, 1))
    else:
        scores = np.full((n, 1), y.mean())
    for _ in range(rounds):
        if classes:
            p = np.exp(scores) / np.exp(scores).sum(axis=1, keepdims=True)
            gradient = ((y[:, None] == np.arange(classes)) - p) * w[:, None]
        else:
            gradient = y[:, None] - scores
        for k in range(scores.shape[1]):
            at = np.zeros(n)
            grow(x, gradient[:, k], edges, depth, least, penalty, at, gains)
            scores[:, k] += rate * at
    return scores, gains


@pytest.mark.parametrize("classes,depth,penalty", [(3, 2, 1.0), (4, 3, 0.5), (0, 2, 1.0), (0, 3, 0.0)])
def test_fit_equals_a_plain_search_of_every_cut(spark, classes, depth, penalty):
    rng = np.random.default_rng(classes + depth)
    x = np.round(rng.normal(size=(60, 3)), 2)
    x[:, 2] = rng.integers(0, 3, 60)
    y = (np.digitize(x[:, 0] + rng.normal(size=60) / 3, [-0.7, 0.0, 0.7][: classes - 1]) if classes else x[:, 0] * 3 + x[:, 2] + rng.normal(size=60) / 5).astype(float)
    w = rng.choice([0.5, 1.0, 2.0], 60) if classes else np.ones(60)
    sizes = {"rounds": 10, "depth": depth, "rate": 0.3, "least": 4, "cuts": 6, "penalty": penalty}
    model = Boosting(classes, **sizes).fit(frame(spark, x, y, w))
    scores, gains = plain_fit(x, y, w, classes, 10, depth, 0.3, 4, 6, penalty)
    assert np.allclose(model.importance, gains, rtol=1e-5)
    got = {tuple(r.features): r for r in model.transform(frame(spark, x, y, w)).collect()}
    for row, s in zip(x.tolist(), scores):
        r = got[tuple(row)]
        if classes:
            p = np.exp(s) / np.exp(s).sum()
            assert np.allclose(r.probabilities, p, atol=1e-6) and r.prediction == p.argmax()
        else:
            assert abs(r.prediction - s[0]) < 1e-6


def test_ten_rows_by_hand(spark):
    """Two classes of five, one cut that parts them: base log(6/12), gradients of a half, leaves 2.5 / (5 + 1)."""
    x = np.array([[float(k)] for k in range(10)])
    y = np.array([0.0] * 5 + [1.0] * 5)
    model = Boosting(2, rounds=1, depth=1, rate=1.0, cuts=9).fit(frame(spark, x, y))
    first, second = model.content["rounds"][0]
    assert model.content["base"] == [math.log(0.5)] * 2
    assert (first["feature"][0], first["threshold"][0]) == (0, 4.0) == (second["feature"][0], second["threshold"][0])
    assert np.allclose(first["value"][1:], [2.5 / 6, -2.5 / 6]) and np.allclose(second["value"][1:], [-2.5 / 6, 2.5 / 6])
    assert np.allclose(model.importance, [2 * 2 * 2.5**2 / 6])


def test_a_fit_does_not_depend_on_how_rows_are_dealt(spark):
    rng = np.random.default_rng(9)
    x, y = rng.normal(size=(200, 4)), rng.integers(0, 3, 200)
    specs = {Boosting(3, rounds=3, depth=3, tried=2).fit(frame(spark, x, y, parts=p)).getOrDefault("spec") for p in (1, 3, 7)}
    assert len(specs) == 1


def test_odd_training_rows(spark):
    nan = float("nan")
    x = np.array([[nan, 1.0], [1.0, 1.0], [2.0, 1.0], [3.0, 1.0]])
    model = Boosting(0, rounds=2, depth=2, least=1).fit(frame(spark, x, np.array([0.0, 1.0, 2.0, 3.0])))
    assert model.importance[1] == 0 and model.transform(frame(spark, x, np.zeros(4))).count() == 4
    same = Boosting(2, rounds=2, depth=2).fit(frame(spark, np.ones((6, 1)), np.zeros(6)))
    assert {r.prediction for r in same.transform(frame(spark, np.ones((2, 1)), np.zeros(2))).collect()} == {0.0}
    none = Boosting(2, rounds=2).fit(frame(spark, x, np.zeros(4)).limit(0))
    assert none.content["rounds"] == [] and none.transform(frame(spark, x, np.zeros(4))).count() == 4
    assert best_split(np.zeros((1, 1)), np.ones((1, 1)), 1.0, np.array([True])) is None


def test_model_is_saved_in_a_pipeline(spark, tmp_path):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(40, 2)), rng.integers(0, 2, 40)
    model, path = Boosting(2, rounds=2, depth=2).fit(frame(spark, x, y)), f"file://{tmp_path}/model"
    PipelineModel([model]).write().overwrite().save(path)
    loaded = PipelineModel.load(path)
    assert isinstance(loaded.stages[0], BoostingModel)
    key = lambda rows: sorted((tuple(r.features), r.probabilities) for r in rows.collect())
    assert key(loaded.transform(frame(spark, x, y))) == key(model.transform(frame(spark, x, y)))


def test_sums_of_gradients_beyond_a_double_are_exact(spark):
    rows = [([k % 3], float(k * 2.0**40), 1.0, [0.0]) for k in range(4000)]
    state = spark.createDataFrame(rows, "bins array<int>, y double, w double, scores array<double>").repartition(7)
    grown = [(np.full(3, -1, np.int64), np.zeros(3, np.int64), np.zeros(3))]
    g, n = Boosting(rounds=1, depth=1)._histogram(state, [], grown, 0, {(0, 0)}, [np.array([0.5, 1.5])], 1.0)[0, 0]
    assert g.tolist() == [[float(sum(k * 2**40 for k in range(4000) if k % 3 == b)) for b in range(3)]] and n.sum() == 4000


def test_medians_and_cuts_read_their_rows_once(spark):
    table = spark.range(1000).select((F.col("id") % 7).cast("double").alias("a"), F.sqrt("id").alias("b"))
    long = table.select(F.posexplode(F.array("a", "b")).alias("feature", "value"))
    for found in (profile.medians(table, ["a", "b"]), profile.quantile_thresholds(long, ["feature"], "value", 24)):
        found.collect()
        final = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert final.count("Range (0, 1000") == 1


@pytest.mark.parametrize("broadcast", ["10m", "-1"])
def test_ranges_do_not_depend_on_how_values_arrive(spark, broadcast):
    """A plan may work out a group's ranges twice, and did with a sketch that keeps other values when they come in another order."""
    values = spark.range(30000).select(F.lit("a").alias("feature"), F.rand(3).alias("value"))
    edges = [profile.range_edges(profile.counted(values, ["feature"], "value").repartition(n, F.xxhash64("__v", F.lit(n))), ["feature"]).first()["__edges"] for n in (1, 3, 7)]
    assert edges[0] == edges[1] == edges[2] and len(edges[0]) == profile.RANGES - 1
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        found = profile.medians(values, ["value"])
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "percentile_approx" not in plan and found.first().value == pytest.approx(np.median([r.value for r in values.select("value").collect()]), abs=0)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_sums_of_few_tasks_are_those_of_a_shuffle(spark):
    rng = np.random.default_rng(3)
    rows = [(rng.integers(0, 3, 2).tolist(), float(rng.normal() * 2.0**44), 1.0, [0.0]) for _ in range(500)]
    state = spark.createDataFrame(rows, "bins array<int>, y double, w double, scores array<double>").repartition(5)
    grown = [(np.full(3, -1, np.int64), np.zeros(3, np.int64), np.zeros(3))]
    edges = [np.array([0.5, 1.5])] * 2
    one, other = (Boosting(rounds=1, depth=1)._histogram(state, [], grown, 0, {(0, 0)}, edges, 1.0, few)[0, 0] for few in (True, False))
    assert (one[0] == other[0]).all() and (one[1] == other[1]).all() and one[1][0].sum() == 500


def test_few_rows_are_summed_in_few_tasks(spark, monkeypatch):
    seen = []
    whole = Boosting._histogram
    monkeypatch.setattr(Boosting, "_histogram", lambda self, state, *rest: seen.append(state.rdd.getNumPartitions()) or whole(self, state, *rest))
    rng = np.random.default_rng(4)
    Boosting(2, rounds=1, depth=1).fit(frame(spark, rng.normal(size=(50, 2)), rng.integers(0, 2, 50), parts=7))
    assert seen == [1]
