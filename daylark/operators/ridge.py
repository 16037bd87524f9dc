"""Ridge regression of all classes from one pass: sums of products by an aggregate, then conjugate gradients on them."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daylark.functions.scalar import PHASES, softmax

SHARPNESS = 4.0  #: factor on the outputs before the softmax


def gram(rows: DataFrame, column: str) -> DataFrame:
    """(i, j, value): sums of products of an array column's entries, the array's first entry at 0; each task sums its own rows first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if len(batch):
                x = batch.column(0).flatten().to_numpy().reshape(len(batch), -1)
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], names=["i", "j", "value"])

    return rows.select(F.col(column).cast("array<double>")).mapInArrow(run, "i long, j long, value double").groupBy("i", "j").agg(F.sum("value").alias("value"))


def conjugate_gradients(matrix: np.ndarray, target: np.ndarray, iterations: int, tolerance: float = 1e-6) -> np.ndarray:
    """The solution of ``matrix @ w = target`` for a symmetric positive matrix, from zero."""
    w, rest = np.zeros_like(target), target.copy()
    step, size = rest.copy(), float(rest @ rest)
    for _ in range(iterations):
        if size**0.5 < tolerance:
            break
        along = matrix @ step
        length = size / (float(step @ along) or 1e-12)
        w, rest = w + length * step, rest - length * along
        last, size = size, float(rest @ rest)
        step = rest + size / last * step
    return w


class Ridge(Estimator):
    """Least squares with a penalty on targets of 1 for a class and -1 for the others, all classes from one scan."""

    def __init__(self, strength: float = 1.0, iterations: int = 60):
        super().__init__()
        self.strength, self.iterations = strength, iterations

    def _fit(self, rows: DataFrame) -> RidgeModel:
        targets = [F.when(F.col("label") == k, 1.0).otherwise(-1.0) for k in range(len(PHASES))]
        every = rows.select(F.concat(F.array(F.lit(1.0), *targets), vector_to_array("features")).alias("z"))
        sums = {(r[0], r[1]): r[2] for r in gram(every, "z").collect()}  # (5 + features) squared
        first = 1 + len(PHASES)
        width = max((i for i, _ in sums), default=first - 1) + 1 - first
        n = sums.get((0, 0), 1.0)
        x = range(first, first + width)
        mean = np.array([sums[0, f] / n for f in x])
        products = np.array([[sums[f, g] for g in x] for f in x]).reshape(width, width) - n * np.outer(mean, mean)
        weights, intercepts = [], []
        for k in range(1, first):
            level = sums.get((0, k), 0.0) / n
            w = conjugate_gradients(products + self.strength * np.eye(width), np.array([sums[k, f] for f in x]) - n * mean * level, self.iterations)
            weights.append(w.tolist())
            intercepts.append(float(level - mean @ w))
        return RidgeModel(spec=json.dumps({"weights": weights, "intercepts": intercepts}))


class RidgeModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """Weights and intercepts as JSON in ``spec``, saved and loaded like MLlib's own models."""

    spec = Param(Params._dummy(), "spec", "weights and intercepts per class as JSON", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, spec: str = ""):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, rows: DataFrame) -> DataFrame:
        own = json.loads(self.getOrDefault(self.spec))
        rows = rows.withColumn("__x", vector_to_array("features"))
        names = [f"__out{k}" for k in range(len(own["intercepts"]))]
        out = {}
        for name, weights, intercept in zip(names, own["weights"], own["intercepts"]):
            terms = F.zip_with("__x", F.array(*map(F.lit, weights)), lambda a, b: a * b)
            out[name] = F.aggregate(terms, F.lit(intercept), lambda a, b: a + b)
        rows = rows.withColumns(out)
        best = F.array_position(F.array(*names), F.greatest(*names)) - 1
        sharp = softmax([F.col(c) * SHARPNESS for c in names])
        return rows.withColumns({"probabilities": F.array(*sharp), "prediction": best.cast("double")}).drop("__x", *names)
