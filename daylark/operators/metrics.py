"""Evaluation tables from predictions, in aggregates only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daylark.functions.scalar import half_up

FLOOR = 1e-12


def confusion(rows: DataFrame, truth: str, predicted: str, classes: Sequence) -> DataFrame:
    """Counts per pair of classes, zeros included, and their share of the true class."""
    labels = F.array(*[F.lit(c) for c in classes])
    grid = rows.sparkSession.range(1).select(F.explode(labels).alias("truth")).withColumn("predicted", F.explode(labels))
    counts = rows.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    full = grid.join(F.broadcast(counts), ["truth", "predicted"], "left").na.fill(0, ["n"])
    totals = full.groupBy("truth").agg(F.sum("n").alias("total"))
    share = F.when(F.col("total") > 0, F.col("n") / F.col("total")).otherwise(F.lit(0.0))
    return full.join(totals, "truth").select("truth", "predicted", "n", share.alias("share"))


def class_report(confused: DataFrame, digits: int = 4) -> DataFrame:
    """Precision, recall, F1 and support per class; 0 where a ratio has no meaning."""
    hit = F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)
    of_truth = confused.groupBy(F.col("truth").alias("class")).agg(F.sum(hit).alias("tp"), F.sum("n").alias("support"))
    of_predicted = confused.groupBy(F.col("predicted").alias("class")).agg(F.sum("n").alias("claimed"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, F.nullif(b, F.lit(0))), F.lit(0.0))
    joined = of_truth.join(of_predicted, "class").withColumns({
        "precision": ratio(F.col("tp"), F.col("claimed")), "recall": ratio(F.col("tp"), F.col("support"))
    })
    p, r = F.col("precision"), F.col("recall")
    f1 = F.when(p + r > 0, 2 * p * r / F.nullif(p + r, F.lit(0.0))).otherwise(F.lit(0.0))
    return joined.select("class", "support", *[half_up(x, digits).alias(n) for x, n in ((p, "precision"), (r, "recall"), (f1, "f1"))])


def overall(rows: DataFrame, truth: str, predicted: str, classes: Sequence, chance: Column | None = None, digits: int = 4) -> DataFrame:
    """Accuracy, macro-F1 and, with the probability of the true class, log loss, in one row."""
    report = class_report(confusion(rows, truth, predicted, classes), 9)
    macro = report.agg(half_up(F.avg("f1"), digits).alias("macro_f1"))
    loss = [half_up(-F.avg(F.log(F.greatest(chance, F.lit(FLOOR)))), digits).alias("log_loss")] if chance is not None else []
    hits = F.avg((F.col(truth) == F.col(predicted)).cast("double"))
    return rows.agg(half_up(hits, digits).alias("accuracy"), F.count(F.lit(1)).alias("n"), *loss).join(F.broadcast(macro))


def regression_report(rows: DataFrame, truth: str, predicted: str, by: Sequence[str] = (), digits: int = 4) -> DataFrame:
    """MAE, RMSE and R² per group; R² is 0 where the truth doesn't vary."""
    y, e = F.col(truth), F.col(truth) - F.col(predicted)
    spread = F.var_pop(y) * F.count(y)
    r2 = F.when(spread > FLOOR, 1 - F.sum(e * e) / F.nullif(spread, F.lit(0.0))).otherwise(F.lit(0.0))
    parts = ((F.avg(F.abs(e)), "mae"), (F.sqrt(F.avg(e * e)), "rmse"), (r2, "r2"))
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[half_up(x, digits).alias(n) for x, n in parts])


def over_folds(folds: DataFrame, by: Sequence[str], columns: Sequence[str], digits: int = 4) -> DataFrame:
    """Mean and population deviation over folds."""
    made = [half_up(f(c), digits).alias(f"{c}_{n}") for c in columns for f, n in ((F.avg, "mean"), (F.stddev_pop, "std"))]
    return folds.groupBy(*by).agg(*made)
