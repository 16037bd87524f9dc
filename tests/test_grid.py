"""Fits side by side: order, errors, bounds, and the same figures as one by one."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from daylark.functions.scalar import PHASES
from daylark.operators import personal, training
from daylark.plans import modelling, relational

SMALL = "/root/testdata/sf0.001"


def test_results_in_order_within_the_bound(spark):
    running, most, lock = [0], [0], threading.Lock()

    def job(k):
        with lock:
            running[0] += 1
            most[0] = max(most[0], running[0])
        time.sleep(0.05)
        found = spark.range(k).count()
        with lock:
            running[0] -= 1
        return found

    assert training.side_by_side(spark, [lambda k=k: job(k) for k in range(7)], 3) == list(range(7))
    assert 2 <= most[0] <= 3
    assert training.side_by_side(spark, []) == []


def test_first_error_is_raised_and_no_further_job_starts(spark):
    begun = []

    def job(k):
        begun.append(k)
        if k == 1:
            raise ValueError("no fit")
        return k

    with pytest.raises(ValueError, match="no fit"):
        training.side_by_side(spark, [lambda k=k: job(k) for k in range(6)], 1)
    assert begun == [0, 1]


@pytest.fixture(scope="module")
def days(spark):
    rows = spark.range(300).select(
        (F.col("id") % 30).cast("int").alias("participant_id"), (F.col("id") / 30).cast("int").alias("day_in_study"),
        F.element_at(F.array(*[F.lit(p) for p in PHASES]), (F.col("id") % 4 + 1).cast("int")).alias("phase"),
        F.when(F.col("id") % 7 != 0, (F.col("id") % 4 + F.col("id") % 3 / 10.0)).alias("a"), (F.col("id") * 37 % 11).cast("double").alias("b"),
        F.when(F.col("id") % 5 != 0, (F.col("id") % 4 * 2.0)).alias("lh"), F.lit(None).cast("double").alias("pdg"),
    )
    return rows.withColumn("split", F.when(F.col("participant_id") < 20, "train").otherwise("val"))


def test_grid_gives_the_figures_of_fits_one_by_one(spark, days):
    folds = days.select("participant_id").distinct().withColumn("fold", F.col("participant_id") % 2)
    run = lambda at_once: list(map(tuple, training.cross_validate(days, folds, ["a", "b"], ["forest", "logistic"], 3, at_once=at_once, trees=3, iterations=5).collect()))
    one, four = run(1), run(4)
    assert one == four and [x[:2] for x in one] == [(m, f) for f in range(2) for m in ("forest", "logistic")]  # fold 2 is empty


def test_hormone_grid_and_a_target_without_values(spark, days):
    runs = [training.hormone_models(days, "split", ["lh", "pdg"], ["a", "b"], at_once=n, rounds=2, trees=2) for n in (1, 3)]
    one, three = (sorted(map(tuple, report.collect())) for report, _ in runs)
    assert one == three and {r.target for r in runs[0][0].collect()} == {"lh"} and len(one) == 3
    assert list(runs[0][1]) == ["lh"] and runs[0][1]["lh"][0] == runs[1][1]["lh"][0]


def test_models_have_all_inputs_and_participants_keep_their_split(spark):
    rows, assigned = modelling.split_panel(spark, SMALL)
    assert len(personal.predictors()) == 55 and set(personal.predictors()) <= set(rows.columns)
    assert rows.count() == relational.study_panel(spark, SMALL).count()
    assert rows.groupBy("participant_id").agg(F.countDistinct("split").alias("n")).where("n <> 1").isEmpty()
    assert assigned.where("(split = 'test') <> (fold is null)").isEmpty()


class Seen(Exception):
    pass


@pytest.fixture
def sizes(monkeypatch):
    """The sizes that a query asks the operators' models for, before any fit."""
    asked = []

    def kept(whole):
        def stop(*args, **given):
            asked.append({k: v for k, v in given.items() if k in ("rounds", "trees", "iterations")})
            raise Seen

        return stop

    for name in ("regressors", "classifiers"):
        monkeypatch.setattr(training, name, kept(getattr(training, name)))
    return asked


def test_hormone_models_of_the_query_have_the_sizes_of_the_study(spark, sizes):
    with pytest.raises(Seen):
        modelling.hormone_regression_metrics(spark, SMALL)
    assert sizes and all(s == {} for s in sizes)


def test_prediction_uses_the_sizes_of_the_study(spark, sizes, monkeypatch):
    with pytest.raises(Seen):
        modelling.predict_phase(spark, SMALL)
    monkeypatch.setattr(training, "classifiers", lambda width, **given: {"forest": lambda: (sizes.append(given), type("Fit", (), {"fit": lambda self, rows: None})())[1]})
    with pytest.raises(Seen):
        modelling.predict_phase(spark, SMALL)
    assert len(sizes) >= 3 and all(s == {} for s in sizes)


def test_leaderboard_uses_the_sizes_of_the_study(spark, sizes, monkeypatch):
    with pytest.raises(Seen):
        modelling.benchmark_leaderboard(spark, SMALL)
    monkeypatch.setattr(training, "cross_validate", lambda *args, **given: None)
    with pytest.raises(Seen):
        modelling.benchmark_leaderboard(spark, SMALL)
    assert len(sizes) >= 2 and all(s == {} for s in sizes)


def test_cross_validation_uses_the_sizes_of_the_study(spark, sizes):
    with pytest.raises(Seen):
        modelling.phase_cv_metrics(spark, SMALL)
    assert sizes and all(s == {} for s in sizes)
