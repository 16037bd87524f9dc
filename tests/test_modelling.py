"""Splits, imputation, smoothing, metrics and models: properties and small fixtures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from daylark.functions import crypto
from daylark.operators import impute, metrics, ridge, smoothing, splits, training
from daylark.functions.scalar import PHASES
from daylark.plans import modelling


@pytest.fixture(scope="module")
def people(spark):
    return spark.range(200).select(F.col("id").cast("int").alias("p"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("s")).cache()


def test_split_is_disjoint_exhaustive_and_stratified(people):
    rows = splits.stratified_split(people, "p", "s").collect()
    assert sorted(r.p for r in rows) == list(range(200))
    sizes = {(s, k): sum(r.s == s and r.split == k for r in rows) for s in "ab" for k in ("train", "val", "test")}
    assert sizes == {("a", "test"): 10, ("a", "val"): 10, ("a", "train"): 47, ("b", "test"): 20, ("b", "val"): 20, ("b", "train"): 93}


def test_ranks_are_a_permutation_per_stratum(people):
    rows = splits.hash_rank(people, "p", "s").collect()
    for s in "ab":
        own = sorted(r["rank"] for r in rows if r.s == s)
        assert own == list(range(len(own)))


def test_folds_differ_by_at_most_one_per_stratum(people):
    rows = splits.stratified_folds(people, "p", "s", 5).collect()
    for s in "ab":
        counts = [sum(r.s == s and r.fold == k for r in rows) for k in range(5)]
        assert max(counts) - min(counts) <= 1


def test_knn_imputes_from_neighbours_and_keeps_values(spark):
    train = spark.createDataFrame([(k, float(k), float(10 * k), float(k % 2)) for k in range(10)], "id int, a double, b double, c double")
    rows = spark.createDataFrame([(100, 3.0, None, None), (101, None, None, None), (102, 4.0, 5.0, 1.0)], "id int, a double, b double, c double")
    got = {r.id: r for r in impute.knn_impute(rows, train, ["id"], ["a", "b"], ["c"], k=3).collect()}
    assert got[100].b == pytest.approx(30.0) and got[100].c == 0.0
    assert got[101].a == 4.5 and got[101].b == 45.0
    assert (got[102].a, got[102].b, got[102].c) == (4.0, 5.0, 1.0)


def test_best_path_against_all_paths():
    rng = np.random.default_rng(1)
    for _ in range(20):
        emission, transition, start = rng.normal(size=(4, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
        def score(path):
            return start[path[0]] + emission[0, path[0]] + sum(transition[a, b] + emission[k + 1, b] for k, (a, b) in enumerate(zip(path, path[1:])))
        paths = np.stack(np.meshgrid(*[range(3)] * 4), axis=-1).reshape(-1, 4)
        assert score(smoothing.best_path(emission, transition, start)) == pytest.approx(max(map(score, paths)))


def test_smoothing_mends_a_lone_outlier(spark):
    rows = spark.createDataFrame([(1, d, *([0.1, 0.9] if d == 3 else [0.8, 0.2])) for d in range(6)], "participant_id int, day_in_study int, p0 double, p1 double")
    out = smoothing.smooth(rows, ["p0", "p1"], np.array([[0.95, 0.05], [0.05, 0.95]]), np.array([0.5, 0.5]))
    assert [r.state for r in out.orderBy("day_in_study").collect()] == [0] * 6


def test_metrics_of_a_known_confusion(spark):
    rows = spark.createDataFrame([(0, 0)] * 3 + [(0, 1)] + [(1, 1)] * 2 + [(2, 0)], "y int, p int")
    report = {r["class"]: r for r in metrics.class_report(metrics.confusion(rows, "y", "p", [0, 1, 2])).collect()}
    assert (report[0].precision, report[0].recall, report[2].f1, report[1].support) == (0.75, 0.75, 0.0, 2)
    assert metrics.overall(rows, "y", "p", [0, 1, 2]).first().accuracy == pytest.approx(0.7143)


def test_regression_report_without_variance(spark):
    rows = spark.createDataFrame([(1.0, 2.0), (1.0, 1.0)], "y double, p double")
    row = metrics.regression_report(rows, "y", "p").first()
    assert (row.mae, row.r2) == (0.5, 0.0)


def test_experts_dispatch_with_fallback(spark):
    rows = spark.createDataFrame(
        [(k, float(k % 4), float(k % 4), "train", 0 if k < 50 else 1) for k in range(60)], "k int, x double, label double, split string, cluster int"
    )
    design = training.Design(rows, ["x"])
    data = design(rows)
    models = training.experts(data, "cluster", lambda: training.classifiers(1, trees=5)["forest"](), least=40)
    out = training.dispatch(data, "cluster", models)
    assert {r.cluster: r.expert for r in out.collect()} == {0: "cluster 0", 1: "common"}
    assert out.where(F.col("prediction") == F.col("label")).count() == 60


def test_median_fill_uses_training_rows_only(spark):
    train = spark.createDataFrame([(1.0,), (3.0,), (None,)], "x double")
    assert training.Design(train, ["x"]).medians == {"x": 2.0}


def test_crypto_rejects_altered_text(spark):
    rows = spark.createDataFrame([("some name",), ("",), (None,)], "t string").withColumn("w", crypto.encrypt(F.col("t"), "s"))
    got = rows.select(crypto.decrypt(F.col("w"), "s"), crypto.decrypt(F.col("w"), "x")).collect()
    assert [tuple(r) for r in got] == [("some name", None), ("", None), (None, None)]


def test_class_order_is_fixed():
    assert PHASES == ("Menstrual", "Follicular", "Fertility", "Luteal")


def test_many_participants_are_smoothed_as_each_alone(spark):
    rng = np.random.default_rng(3)
    rows = [(p, d, *(float(x) for x in rng.dirichlet(np.ones(3)))) for p in range(23) for d in range(rng.integers(1, 30))]
    transition, prior = rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(3))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # participants cross batches
    try:
        frame = spark.createDataFrame(rows, "participant_id int, day_in_study int, a double, b double, c double")
        got = {(r.participant_id, r.day_in_study): r.state for r in smoothing.smooth(frame, list("abc"), transition, prior).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    log_t, log_p = np.log(transition), np.log(prior)
    assert len(got) == len(rows)
    for p in range(23):
        own = sorted(r for r in rows if r[0] == p)
        chance = np.log(np.array([r[2:] for r in own]))
        score, back = log_p + chance[0] - log_p, []
        for e in chance[1:]:
            ways = score[:, None] + log_t
            back.append(ways.argmax(axis=0))
            score = ways.max(axis=0) + e - log_p
        path = [int(score.argmax())]
        for step in reversed(back):
            path.append(int(step[path[-1]]))
        assert [got[p, r[1]] for r in own] == path[::-1]


def test_ridge_against_normal_equations(spark):
    from pyspark.ml.linalg import Vectors

    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(60, 2)), rng.integers(0, 4, 60)
    x[:, 0] += y
    rows = spark.createDataFrame([(Vectors.dense(a), float(b)) for a, b in zip(x.tolist(), y.tolist())], ["features", "label"])
    got = [r.prediction for r in ridge.Ridge(strength=3.0).fit(rows).transform(rows).collect()]
    centred, out = x - x.mean(axis=0), []
    for k in range(4):
        target = np.where(y == k, 1.0, -1.0)
        w = np.linalg.solve(centred.T @ centred + 3.0 * np.eye(2), centred.T @ (target - target.mean()))
        out.append(centred @ w + target.mean())
    assert got == np.argmax(out, axis=0).tolist()


def test_training_picks_refits_saves_and_loads(spark, tmp_path):
    from pyspark.ml import PipelineModel

    rng = np.random.default_rng(5)
    rows = [(p, d, PHASES[k], float(k + rng.normal() / 4) if d % 5 else None, float(rng.normal())) for p in range(24) for d in range(8) for k in [int(rng.integers(0, 4))]]
    frame = spark.createDataFrame(rows, "participant_id int, day_in_study int, phase string, a double, b double").withColumn("split", F.when(F.col("participant_id") % 4 == 0, "test").otherwise("train"))
    folds = spark.createDataFrame([(p, p % 2) for p in range(24)], "participant_id int, fold int")
    path = f"file://{tmp_path}/model"
    report, winner, (accuracy, _) = training.train_phase(frame, folds, "split", ["a", "b"], ["logistic", "ridge"], 2, path, rounds=2, trees=3, iterations=20)
    assert report.count() == 4 and winner in ("logistic", "ridge") and accuracy > 0.6
    for names in (["logistic"], ["ridge"], ["boosting"]):
        _, winner, (accuracy, _) = training.train_phase(frame, folds, "split", ["a", "b"], names, 2, path, rounds=2, trees=3, iterations=20)
        loaded = PipelineModel.load(path).transform(training.labelled(frame.where("split = 'test'")))
        assert [winner] == names and training.evaluate(loaded)[0] == accuracy


def test_gram_and_conjugate_gradients(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(50, 4))
    rows = spark.createDataFrame([(a,) for a in x.tolist()], "z array<double>").repartition(3)
    got = np.zeros((4, 4))
    for r in ridge.gram(rows, "z").collect():
        got[r.i, r.j] = r.value
    assert np.allclose(got, x.T @ x)
    assert np.allclose(ridge.conjugate_gradients(got + np.eye(4), np.arange(4.0), 60), np.linalg.solve(got + np.eye(4), np.arange(4.0)))
    assert ridge.gram(rows.limit(0), "z").count() == 0


def test_smoothing_learns_from_the_other_folds_alone(spark):
    """Participants of fold 0 change phase daily, those of fold 1 never: each fold is smoothed by the other's habit."""
    days = [(p, d, PHASES[(d % 2) if p < 4 else (p % 2)]) for p in range(8) for d in range(12)]
    rows = spark.createDataFrame(days, "participant_id int, day_in_study int, phase string")
    folds = spark.createDataFrame([(p, 0 if p < 4 else 1) for p in range(8)], "participant_id int, fold int")
    even = [(p, d, 0 if p < 4 else 1, 0.0, 0.0, [0.51, 0.49, 0.0, 0.0]) for p in range(8) for d in range(12)]
    found = spark.createDataFrame(even, "participant_id int, day_in_study int, fold int, label double, prediction double, probabilities array<double>")
    got = {}
    for r in training.smoothed(found, rows, folds, 2).orderBy("participant_id", "day_in_study").collect():
        got.setdefault(r.participant_id, []).append(r.prediction)
    assert all(len(set(got[p])) == 1 for p in range(4)) and all(all(a != b for a, b in zip(got[p], got[p][1:])) for p in range(4, 8))
    report = training.by_fold(found, "x").collect()
    assert [(r.method, r.fold, r.accuracy) for r in report] == [("x", 0, 1.0), ("x", 1, 1.0)]


def test_out_of_fold_covers_every_row_once(spark):
    rng = np.random.default_rng(6)
    data = [(p, d, PHASES[int(rng.integers(0, 4))], float(rng.normal())) for p in range(9) for d in range(5)]
    rows = spark.createDataFrame(data, "participant_id int, day_in_study int, phase string, a double")
    folds = spark.createDataFrame([(p, p % 3) for p in range(9)], "participant_id int, fold int")
    for name in ("boosting", "logistic"):
        found = training.out_of_fold(rows, folds, ["a"], name, 3, rounds=1, iterations=3)
        assert found.count() == 45 and found.select("participant_id", "day_in_study").distinct().count() == 45
        assert all(abs(sum(r.probabilities) - 1) < 1e-9 and r.fold == r.participant_id % 3 for r in found.collect())


def test_importances_and_cluster_sizes(spark):
    gains = spark.createDataFrame([(f"f{k:02}", float(k)) for k in range(20)], "feature string, gain double")
    top = training.importances(gains).collect()
    assert len(top) == 15 and top[0].feature == "f19" and top[0].importance == 0.1
    assert {r.importance for r in training.importances(gains.withColumn("gain", F.lit(0.0))).collect()} == {0.0}
    sizes = training.cluster_sizes(spark.createDataFrame([(0,), (2,), (2,)], "cluster int"), 3)
    assert {r.cluster: r.n for r in sizes.collect()} == {0: 1, 1: 0, 2: 2}


def test_the_panel_is_built_once_for_weights_and_fits(spark):
    rows, train, _ = modelling._fitted(spark, "/root/testdata/sf0.001")
    plan = train._jdf.queryExecution().executedPlan().toString()
    assert "parquet" not in plan and "Aggregate" not in plan and "Join" not in plan  # all of them before
    n = {r["phase"]: r["count"] for r in rows.groupBy("phase").count().collect()}
    weights = {r["phase"]: r["weight"] for r in rows.select("phase", "weight").distinct().collect()}
    assert weights == {p: sum(n.values()) / (4.0 * n[p]) for p in n}


def test_the_leaderboard_joins_rolling_values_to_a_written_panel(spark, monkeypatch):
    class Seen(Exception):
        pass

    def stop(rows, value):
        raise Seen(rows._jdf.queryExecution().executedPlan().toString())

    monkeypatch.setattr(modelling.panel, "rolling_last_observed", stop)
    with pytest.raises(Seen) as found:
        modelling.benchmark_leaderboard(spark, "/root/testdata/sf0.001")
    assert "parquet" not in str(found.value) and "Join" not in str(found.value)  # both before


def test_imputation_reads_tables_anew(spark, tmp_path):
    """Other rows under the path of a run before: its cached panel was found again."""
    small = "/root/testdata/sf0.001"
    spark.read.parquet(f"{small}/customer.parquet").write.parquet(f"{tmp_path}/customer.parquet")
    found = []
    for part in ("user_id % 2 = 0", "user_id % 2 = 1"):
        spark.read.parquet(f"{small}/events.parquet").where(part).write.mode("overwrite").parquet(f"{tmp_path}/events.parquet")
        found.append({r.participant_id % 2 for r in modelling.knn_impute(spark, str(tmp_path)).collect()})
    assert found == [{0}, {1}]
