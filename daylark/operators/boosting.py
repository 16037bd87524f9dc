"""Gradient boosting on histograms: several classes under one softmax, and regression with a penalty on leaves.

Features are cut once at exact quantiles of all training rows. A level of a round's trees is one aggregate:
gradients and rows summed by (tree, node, feature, bin), whose size is bound by the model's shape
and not by the data; the driver picks the splits from it. All classes of a round start from the same
softmax and are grown side by side. Gradients are summed as whole numbers (a power of two times the gradient,
rounded), so that a fit is the same however the rows are dealt to tasks. Rows, their bins and their scores are
checkpointed every few rounds; in between a task adds the new trees' outputs itself.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daylark.operators import profile
from daylark.session import checkpointed

LEAST_GAIN = 1e-12
#: Rounds after which scores are written, and the bits of a gradient of the largest size.
STORE_EVERY, BITS = 8, 30
#: Rows that a task sums at least where there are so many, and tasks up to which the driver adds their sums itself.
TASK_ROWS, FEW_TASKS = 8192, 8


def routed(bins: np.ndarray, feature: np.ndarray, cut: np.ndarray, depth: int) -> np.ndarray:
    """The node (root 0, children 2 i + 1 and 2 i + 2) that each row ends in; ``feature`` is negative at leaves."""
    at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
    for _ in range(depth):
        f = feature[at]
        right = bins[rows, np.maximum(f, 0)] > cut[at]
        at = np.where(f >= 0, 2 * at + 1 + right, at)
    return at


def softmaxed(scores: np.ndarray) -> np.ndarray:
    shifted = np.exp(scores - scores.max(axis=1, keepdims=True))
    return shifted / shifted.sum(axis=1, keepdims=True)


def best_split(g: np.ndarray, n: np.ndarray, penalty: float, tried: np.ndarray) -> tuple[float, int, int] | None:
    """(gain, feature, bin) of the best cut of a node from its sums (features, bins); ties go to the first feature and cut."""
    left_g, left_n = np.cumsum(g, axis=1)[:, :-1], np.cumsum(n, axis=1)[:, :-1]
    all_g, all_n = g[0].sum(), n[0].sum()
    right_g, right_n = all_g - left_g, all_n - left_n
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left_g**2 / (left_n + penalty) + right_g**2 / (right_n + penalty) - all_g**2 / (all_n + penalty)
    gain[(left_n < 1) | (right_n < 1)] = -np.inf
    gain[~tried] = -np.inf
    if not gain.size:
        return None
    f, b = np.unravel_index(gain.argmax(), gain.shape)
    return (float(gain[f, b]), int(f), int(b)) if gain[f, b] > LEAST_GAIN else None


class Boosting(Estimator):
    """Boosted trees on a ``features`` vector; ``classes`` 0 is regression on the label, more are labels from 0.

    ``rows`` may have a ``weight`` column, a factor on a class's gradients. ``tried`` features are looked at in a node
    (0: all), nodes of fewer than ``least`` rows are leaves, a leaf is its gradients' sum over rows plus ``penalty``.
    """

    def __init__(self, classes: int = 0, rounds: int = 250, depth: int = 5, rate: float = 0.05, tried: int = 0, least: int = 4, cuts: int = 24, penalty: float = 1.0, seed: int = 42, label: str = "label"):
        super().__init__()
        self.classes, self.rounds, self.depth, self.rate, self.tried = classes, rounds, depth, rate, tried
        self.least, self.cuts, self.penalty, self.seed, self.label = least, cuts, penalty, seed, label

    def setLabelCol(self, label: str) -> Boosting:  # noqa: N802  as MLlib's estimators have it
        self.label = label
        return self

    def _fit(self, rows: DataFrame) -> BoostingModel:
        weight = F.col("weight") if "weight" in rows.columns and self.classes else F.lit(1.0)
        data = rows.select(vector_to_array("features").alias("x"), F.col(self.label).cast("double").alias("y"), weight.cast("double").alias("w"))
        data = checkpointed(data.where("y is not null"))
        trees = max(1, self.classes)
        long = data.select(F.posexplode("x").alias("feature", "value")).where("not isnan(value)")
        cuts: dict[int, list[float]] = {}
        for f, _, value in sorted(map(tuple, profile.quantile_thresholds(long, ["feature"], "value", self.cuts).collect())):  # features times cuts
            cuts.setdefault(f, []).append(value)
        facts = data.agg(F.max(F.size("x")), F.count(F.lit(1)), F.avg("y"), F.max("w")).first()
        width, n, mean = facts[0] or 0, facts[1], facts[2] or 0.0
        edges = [np.array(cuts.get(f, []), np.float64) for f in range(width)]
        if self.classes:
            counts = {r[0]: r[1] for r in data.groupBy("y").count().collect()}
            base = np.log([(counts.get(float(k), 0) + 1) / (n + trees) for k in range(trees)])
            largest = facts[3] or 1.0
        else:
            base = np.array([mean])
            largest = data.agg(F.max(F.abs(F.col("y") - mean))).first()[0] or 1.0
        scale = 2.0 ** (BITS - np.ceil(np.log2(largest)))
        # a level is a job of its own: with few rows most of its time would go into starting tasks
        tasks = max(1, -(-n // TASK_ROWS))
        state = checkpointed(_binned(data, edges, base).coalesce(tasks))
        size, importance = 2 ** (self.depth + 1) - 1, np.zeros(width)
        rounds, gains, pending = [], [], []
        for t in range(self.rounds if width and n else 0):
            grown = [(np.full(size, -1, np.int64), np.zeros(size, np.int64), np.zeros(size)) for _ in range(trees)]
            gains.append(np.zeros((trees, size)))
            active = {(k, 0) for k in range(trees)}
            for level in range(self.depth):
                if not active:
                    break
                sums = self._histogram(state, pending, grown, level, active, edges, scale, tasks <= FEW_TASKS)
                following = set()
                for k, node in sorted(active):
                    g, c = sums.get((k, node), (None, None))
                    if g is None:
                        continue
                    feature, cut, value = grown[k]
                    all_g, all_n = g[0].sum(), c[0].sum()
                    if node == 0:
                        value[0] = all_g / (all_n + self.penalty)
                    if all_n < self.least:
                        continue
                    order = np.random.default_rng([self.seed, t, k, node]).permutation(width)
                    tried = np.isin(np.arange(width), order[: self.tried or width])
                    found = best_split(g, c, self.penalty, tried)
                    if found is None:
                        continue
                    gain, f, b = found
                    importance[f] += gain
                    gains[-1][k, node] = gain
                    feature[node], cut[node] = f, b
                    left_g, left_n = g[f, : b + 1].sum(), c[f, : b + 1].sum()
                    value[2 * node + 1] = left_g / (left_n + self.penalty)
                    value[2 * node + 2] = (all_g - left_g) / (all_n - left_n + self.penalty)
                    following |= {(k, 2 * node + 1), (k, 2 * node + 2)}
                active = following
            rounds.append(grown)
            pending = [*pending, grown]
            if len(pending) == STORE_EVERY and t + 1 < self.rounds:
                state, pending = checkpointed(_advanced(state, pending, self.depth, self.rate)), []
        named = [
            [{"feature": f.tolist(), "threshold": [float(edges[a][b]) if a >= 0 else 0.0 for a, b in zip(f, c)], "value": v.tolist(), "gain": g.tolist()} for (f, c, v), g in zip(grown, own)]
            for grown, own in zip(rounds, gains)
        ]
        spec = {"classes": self.classes, "depth": self.depth, "rate": self.rate, "base": base.tolist(), "rounds": named, "importance": importance.tolist()}
        return BoostingModel(spec=json.dumps(spec))

    def _histogram(self, state: DataFrame, pending: list, grown: list, level: int, active: set, edges: list[np.ndarray], scale: float, few: bool = False) -> dict:
        """Sums of gradients and rows (features, bins) for each active (tree, node) of the level; those of a ``few`` tasks are added here."""
        width, bins = len(edges), max(map(len, edges)) + 1
        first = 2**level - 1
        classes, depth, rate = self.classes, self.depth, self.rate
        wanted = np.zeros((len(grown), 2**level), bool)
        for k, node in active:
            wanted[k, node - first] = True

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            g_sums = np.zeros((len(grown), width, 2**level * bins), np.int64)
            n_sums = np.zeros_like(g_sums)
            for batch in batches:
                if not len(batch):
                    continue
                own, y, w, scores = _unpacked(batch, width)
                scores = _scored(own, scores, pending, depth, rate)
                if classes:
                    gradient = ((y[:, None] == np.arange(classes)) - softmaxed(scores)) * w[:, None]
                else:
                    gradient = y[:, None] - scores
                whole = np.rint(gradient * scale)
                columns = np.ascontiguousarray(own.T, dtype=np.int64)
                for k, (feature, cut, _) in enumerate(grown):
                    node = routed(own, feature, cut, level) - first
                    keep = np.flatnonzero((node >= 0) & wanted[k][np.maximum(node, 0)])
                    start, weight = node[keep] * bins, whole[keep, k]
                    for f in range(width):
                        at = start + columns[f][keep]
                        g_sums[k, f] += np.bincount(at, weight, g_sums.shape[2]).astype(np.int64)
                        n_sums[k, f] += np.bincount(at, minlength=g_sums.shape[2])
            k, f, at = np.nonzero(n_sums)
            g = g_sums[k, f, at]
            made = [k, first + at // bins, f, at % bins, g >> 32, g & 0xFFFFFFFF, n_sums[k, f, at]]
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in made], names=["tree", "node", "feature", "bin", "high", "low", "n"])

        # a sum is kept in two halves, each far from a long's bound
        parts = state.mapInArrow(run, "tree long, node long, feature long, bin long, high long, low long, n long")
        if not few:
            parts = parts.groupBy("tree", "node", "feature", "bin").agg(*[F.sum(c).alias(c) for c in ("high", "low", "n")])
        found = parts.toArrow()  # at most trees x nodes x features x bins, of each task if few
        k, node, f, b, *sums = (found.column(c).to_numpy() for c in found.column_names)
        high_all, low_all, n_all = (np.zeros((len(grown), 2**level, width, bins), np.int64) for _ in range(3))
        for total, own in zip((high_all, low_all, n_all), sums):
            np.add.at(total, (k, node - first, f, b), own)
        g_all = (high_all.astype(np.float64) * 2.0**32 + low_all) / scale
        n_all = n_all.astype(np.float64)
        return {(a, first + c): (g_all[a, c], n_all[a, c]) for a, c in set(zip(k.tolist(), (node - first).tolist()))}


def _binned(data: DataFrame, edges: list[np.ndarray], base: np.ndarray) -> DataFrame:
    """(bins, y, w, scores): bin b of a feature holds what is above b of its cuts; what isn't a number is in bin 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x = batch.column(0).flatten().to_numpy().reshape(len(batch), len(edges))
            bins = np.stack([np.where(np.isnan(x[:, f]), 0, np.searchsorted(e, x[:, f])) for f, e in enumerate(edges)], axis=1).astype(np.int32)
            yield _packed(bins, batch.column(1), batch.column(2), np.tile(base, (len(batch), 1)))

    return data.mapInArrow(run, "bins array<int>, y double, w double, scores array<double>")


def _packed(bins: np.ndarray, y: pa.Array, w: pa.Array, scores: np.ndarray) -> pa.RecordBatch:
    lists = [pa.ListArray.from_arrays(np.arange(0, a.size + 1, a.shape[1], dtype=np.int32), pa.array(a.ravel())) for a in (bins, scores)]
    return pa.RecordBatch.from_arrays([lists[0], y, w, lists[1]], names=["bins", "y", "w", "scores"])


def _unpacked(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    bins = batch.column(0).flatten().to_numpy().reshape(len(batch), width)
    return bins, batch.column(1).to_numpy(), batch.column(2).to_numpy(), batch.column(3).flatten().to_numpy().reshape(len(batch), -1)


def _scored(bins: np.ndarray, scores: np.ndarray, rounds: list, depth: int, rate: float) -> np.ndarray:
    scores = scores.copy()
    for grown in rounds:
        for k, (feature, cut, value) in enumerate(grown):
            scores[:, k] += rate * value[routed(bins, feature, cut, depth)]
    return scores


def _advanced(state: DataFrame, rounds: list, depth: int, rate: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                width = len(batch.column(0).flatten()) // len(batch)
                bins, _, _, scores = _unpacked(batch, width)
                yield _packed(bins, batch.column(1), batch.column(2), _scored(bins, scores, rounds, depth, rate))

    return state.mapInArrow(run, "bins array<int>, y double, w double, scores array<double>")


class BoostingModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """Fitted trees as JSON in ``spec``, so that the model is saved and loaded like MLlib's own, alone or in a pipeline."""

    spec = Param(Params._dummy(), "spec", "trees, base scores, rate and gains as JSON", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, spec: str = ""):
        super().__init__()
        self._set(**self._input_kwargs)

    @property
    def content(self) -> dict:
        return json.loads(self.getOrDefault(self.spec))

    @property
    def importance(self) -> list[float]:
        """Gains of all splits, per feature."""
        return self.content["importance"]

    def _transform(self, rows: DataFrame) -> DataFrame:
        own = self.content
        base, rate, depth = np.array(own["base"]), own["rate"], own["depth"]
        trees = [[tuple(np.array(tree[k]) for k in ("feature", "threshold", "value")) for tree in grown] for grown in own["rounds"]]

        @F.pandas_udf("array<double>")
        def scores(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=object)
            x = np.stack(x.to_numpy())
            return pd.Series(list(_scored(x, np.tile(base, (len(x), 1)), trees, depth, rate)))

        scored = rows.withColumn("__scores", scores(vector_to_array("features")))
        if not own["classes"]:
            return scored.withColumn("prediction", F.col("__scores")[0]).drop("__scores")
        powers = F.transform("__scores", lambda s: F.exp(s - F.array_max("__scores")))
        scored = scored.withColumn("__powers", powers).withColumn("__total", F.aggregate("__powers", F.lit(0.0), lambda a, b: a + b))
        chosen = (F.array_position("__scores", F.array_max("__scores")) - 1).cast("double")
        return scored.withColumns({"probabilities": F.transform("__powers", lambda p: p / F.col("__total")), "prediction": chosen}).drop("__scores", "__powers", "__total")
