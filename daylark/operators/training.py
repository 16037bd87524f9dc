"""Phase classifiers and hormone regressors on distributed MLlib estimators.

The daily panel may be far larger than a worker, so every fit is a Spark job over all training rows;
medians, encodings and metrics are aggregates. Folds and splits keep a participant's rows together.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, PipelineModel
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import SQLTransformer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daylark.functions.scalar import PHASES, class_index, half_up
from daylark.operators import metrics, panel, profile, smoothing
from daylark.operators.boosting import Boosting
from daylark.operators.ridge import Ridge
from daylark.session import checkpointed

SEED = 42
#: Fits that run side by side: each holds its estimator's state in executors and its model in the driver.
AT_ONCE = 4


def classifiers(width: int, rounds: int = 250, trees: int = 300, iterations: int = 60) -> dict[str, Callable[[], Estimator]]:
    """Estimators by name, with the study's sizes as defaults."""
    return {
        "boosting": lambda: Boosting(len(PHASES), rounds=rounds, depth=5, rate=0.05, tried=11, least=4, cuts=24, penalty=1.0, seed=SEED),
        "forest": lambda: RandomForestClassifier(numTrees=trees, maxDepth=16, minInstancesPerNode=2, seed=SEED),
        "logistic": lambda: LogisticRegression(maxIter=iterations, regParam=1e-4, weightCol="weight"),
        "ridge": lambda: Ridge(iterations=iterations),
        "perceptron": lambda: MultilayerPerceptronClassifier(layers=[width, 16, len(PHASES)], maxIter=iterations, blockSize=128, seed=SEED),
    }


def regressors(rounds: int = 120, trees: int = 40) -> dict[str, Callable[[], Estimator]]:
    return {
        "forest": lambda: RandomForestRegressor(numTrees=trees, maxDepth=8, minInstancesPerNode=5, seed=SEED),
        "boosting": lambda: GBTRegressor(maxIter=rounds, maxDepth=3, stepSize=0.05, seed=SEED),
        "penalised_boosting": lambda: Boosting(rounds=rounds + rounds // 4, depth=4, rate=0.05, tried=10, cuts=16, penalty=1.0, seed=SEED),
    }


class Design:
    """Median fill learned on training rows, and the feature vector made of it."""

    def __init__(self, train: DataFrame, predictors: Sequence[str]):
        self.predictors = list(predictors)
        self.medians = profile.medians(train, predictors, empty=0.0).first().asDict()
        raw = VectorAssembler(inputCols=[f"__{p}" for p in predictors], outputCol="raw")
        self.assemble = lambda rows: raw.transform(self.filled(rows)).drop(*[f"__{p}" for p in predictors])
        self.scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True).fit(self.assemble(train))

    def filled(self, rows: DataFrame) -> DataFrame:
        return rows.withColumns({f"__{p}": F.coalesce(F.col(p).cast("double"), F.lit(float(self.medians[p]))) for p in self.predictors})

    def pipeline(self, model) -> PipelineModel:
        """Filling, assembling, scaling and the model as one MLlib pipeline, which can be saved and loaded."""
        fills = ", ".join(f"coalesce(double(`{p}`), double({self.medians[p]!r})) AS `__{p}`" for p in self.predictors)
        raw = VectorAssembler(inputCols=[f"__{p}" for p in self.predictors], outputCol="raw")
        return PipelineModel([SQLTransformer(statement=f"SELECT *, {fills} FROM __THIS__"), raw, self.scaler, model])

    def __call__(self, rows: DataFrame) -> DataFrame:
        return self.scaler.transform(self.assemble(rows)).drop("raw")


def labelled(rows: DataFrame, phase: str = "phase") -> DataFrame:
    """Rows of the four classes with ``label`` and a class weight; ``rows`` are counted at once, so give what is cheap to read twice."""
    known = rows.withColumn("label", class_index(F.col(phase)).cast("double")).where("label is not null")
    weights = F.lit(None).cast("double")
    for own in profile.class_weights(known, phase).collect():  # one row a class
        weights = F.when(F.col(phase) == own[phase], F.lit(own["weight"])).otherwise(weights)
    return known.select(phase, *[c for c in known.columns if c != phase], weights.alias("weight"))


def evaluate(predicted: DataFrame) -> tuple[float, float]:
    row = metrics.overall(predicted, "label", "prediction", [float(k) for k in range(len(PHASES))]).first()
    return row["accuracy"], row["macro_f1"]


def side_by_side(spark: SparkSession, jobs: Sequence[Callable[[], object]], at_once: int = AT_ONCE) -> list:
    """Results of ``jobs`` in their order, ``at_once`` of them running at a time, each in a scheduler pool of its own.

    A fit is a chain of small jobs that leaves executors idle; others fill them. In fair mode (``session.build`` sets it)
    pools share executors evenly. After a failure no further job is started and the first error is raised.
    """
    failed = []

    def guarded(at: int, job: Callable[[], object]):
        if failed:
            return None
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"fit {at % at_once}")
        try:
            return job()
        except BaseException as error:
            failed.append(error)
            raise

    with ThreadPoolExecutor(max(1, at_once)) as pool:
        running = [pool.submit(inheritable_thread_target(spark)(guarded), at, job) for at, job in enumerate(jobs)]
    if failed:
        raise failed[0]
    return [f.result() for f in running]


def cross_validate(
    rows: DataFrame, folds: DataFrame, predictors: Sequence[str], names: Sequence[str], k: int, person: str = "participant_id", at_once: int = AT_ONCE, **sizes
) -> DataFrame:
    """(method, fold, accuracy, macro_f1) over all folds; medians and scales come from each fold's training rows.

    Each fold's vectors are written once to the shared folder, so that memory is bound by the ``at_once`` fits that run, not by
    the grid. Folds without training or test rows are left out. The figures don't depend on ``at_once``.
    """
    spark = rows.sparkSession
    data = checkpointed(labelled(rows).join(folds.select(person, "fold"), person))

    def prepared(fold: int):
        train, test = data.where(F.col("fold") != fold), data.where(F.col("fold") == fold)
        if train.isEmpty() or test.isEmpty():
            return None
        design = Design(train, predictors)
        return checkpointed(design(train).select("features", "label", "weight")), checkpointed(design(test).select("features", "label"))

    vectors = side_by_side(spark, [lambda fold=fold: prepared(fold) for fold in range(k)], at_once)
    cells = [(name, fold) for fold in range(k) if vectors[fold] for name in names]

    def fitted(name: str, fold: int):
        train, test = vectors[fold]
        return evaluate(classifiers(len(predictors), **sizes)[name]().fit(train).transform(test))

    scores = side_by_side(spark, [lambda cell=cell: fitted(*cell) for cell in cells], at_once)
    out = [(name, fold, *score) for (name, fold), score in zip(cells, scores)]
    return spark.createDataFrame(out, "method string, fold int, accuracy double, macro_f1 double")


def out_of_fold(rows: DataFrame, folds: DataFrame, predictors: Sequence[str], name: str, k: int, person: str = "participant_id", day: str = "day_in_study", **sizes) -> DataFrame:
    """(person, day, fold, label, prediction, probabilities): each row as the model of the other folds sees it; written once."""
    data = checkpointed(labelled(rows).join(folds.select(person, "fold"), person))

    def predicted(fold: int):
        train, test = data.where(F.col("fold") != fold), data.where(F.col("fold") == fold)
        if train.isEmpty() or test.isEmpty():
            return None
        design = Design(train, predictors)
        found = classifiers(len(predictors), **sizes)[name]().fit(design(train)).transform(design(test))
        chances = F.col("probabilities") if "probabilities" in found.columns else vector_to_array("probability")
        return checkpointed(found.select(person, day, "fold", "label", "prediction", chances.alias("probabilities")))

    out = None
    for one in side_by_side(rows.sparkSession, [lambda fold=fold: predicted(fold) for fold in range(k)]):
        if one is not None:
            out = one if out is None else out.unionByName(one)
    empty = f"`{person}` {rows.schema[person].dataType.simpleString()}, `{day}` {rows.schema[day].dataType.simpleString()}, fold int, label double, prediction double, probabilities array<double>"
    return out if out is not None else rows.sparkSession.createDataFrame([], empty)


def smoothed(found: DataFrame, rows: DataFrame, folds: DataFrame, k: int, person: str = "participant_id", day: str = "day_in_study") -> DataFrame:
    """``found`` (from ``out_of_fold``) with the states of each participant's best path as predictions.

    A fold's transitions and prior are counted over the participants of the other folds alone.
    """
    known = checkpointed(rows.select(person, day, "phase").join(folds.select(person, "fold"), person))
    names = [f"__p{c}" for c in range(len(PHASES))]
    wide = found.select("*", *[F.col("probabilities")[c].alias(n) for c, n in enumerate(names)])
    out = None
    for fold in range(k):
        train = known.where(F.col("fold") != fold)
        own = wide.where(F.col("fold") == fold)
        change, first = np.zeros((len(PHASES), len(PHASES))), np.zeros(len(PHASES))
        for t in panel.transition_matrix(train).collect():
            change[PHASES.index(t["from"]), PHASES.index(t["to"])] = t["probability"]
        for t in panel.prior(train).collect():
            first[PHASES.index(t["phase"])] = t["probability"]
        path = smoothing.smooth(own.select(person, day, *names), names, change, first, person, day)
        one = own.drop("prediction", *names).join(path, [person, day]).withColumn("prediction", F.col("state").cast("double")).drop("state")
        out = one if out is None else out.unionByName(one)
    return out.select(*found.columns)


def by_fold(found: DataFrame, method: str) -> DataFrame:
    """(method, fold, accuracy, macro_f1) of predictions with their fold."""
    out = [(method, fold, *evaluate(found.where(F.col("fold") == fold))) for fold in sorted(r[0] for r in found.select("fold").distinct().collect())]
    return found.sparkSession.createDataFrame(out, "method string, fold int, accuracy double, macro_f1 double")


def leaderboard(folds: DataFrame) -> DataFrame:
    """Mean and deviation per method, best mean macro-F1 first, ties by name."""
    return metrics.over_folds(folds, ["method"], ["accuracy", "macro_f1"]).orderBy(F.desc("macro_f1_mean"), "method")


def train_phase(rows: DataFrame, folds: DataFrame, split: str, predictors: Sequence[str], names: Sequence[str], k: int, path: str | None = None, person: str = "participant_id", **sizes):
    """(report, winner, test metrics): cross-validation on the pool (train and val), refit of the winner on the pool, test.

    The winner has the best mean macro-F1, the earlier name on ties. With a ``path`` the fitted pipeline is
    saved there; ``PipelineModel.load`` brings it back.
    """
    pool = rows.where(F.col(split) != "test")
    report = cross_validate(pool, folds, predictors, names, k, person, **sizes)
    scores = {r["method"]: r["score"] for r in report.groupBy("method").agg(F.avg("macro_f1").alias("score")).collect()}
    winner = max((n for n in names if n in scores), key=lambda n: scores[n])
    fit_rows = labelled(pool)
    design = Design(fit_rows, predictors)
    model = classifiers(len(predictors), **sizes)[winner]().fit(design(fit_rows))
    test = evaluate(model.transform(design(labelled(rows.where(F.col(split) == "test")))))
    if path:
        design.pipeline(model).write().overwrite().save(path)
    return report, winner, test


def importances(features: DataFrame, name: str = "feature", value: str = "gain", most: int = 15) -> DataFrame:
    """The ``most`` largest shares of the total, rounded to four places; ties by name. Without a total all are 0."""
    total = features.agg(F.sum(value).alias("__total"))
    share = F.when(F.col("__total") > 0, F.col(value) / F.col("__total")).otherwise(F.lit(0.0))
    rated = features.join(F.broadcast(total)).select(name, half_up(share, 4).alias("importance"))
    return rated.orderBy(F.desc("importance"), name).limit(most)


def cluster_sizes(assigned: DataFrame, k: int, cluster: str = "cluster") -> DataFrame:
    """(cluster, n) for each of ``k`` clusters, also for empty ones."""
    every = assigned.sparkSession.range(k).select(F.col("id").cast("int").alias(cluster))
    return every.join(assigned.groupBy(cluster).agg(F.count(F.lit(1)).alias("n")), cluster, "left").na.fill(0, ["n"])


def hormone_models(rows: DataFrame, split: str, targets: Sequence[str], predictors: Sequence[str], at_once: int = AT_ONCE, **sizes) -> tuple[DataFrame, dict]:
    """Validation metrics per (target, method), and per target the model with the best R², the earlier on ties.

    Medians come from all training rows; a fit takes the rows that have its target. Fits run side by side over vectors that
    are written once. A target without training or validation rows has no entry.
    """
    spark = rows.sparkSession
    design = Design(rows.where(F.col(split) == "train"), predictors)
    data = checkpointed(design(rows).select("features", split, *targets))
    parts = {t: [data.where(F.col(t).isNotNull() & (F.col(split) == part)) for part in ("train", "val")] for t in targets}
    cells = [(t, name) for t in targets if not any(p.isEmpty() for p in parts[t]) for name in regressors(**sizes)]

    def fitted(target: str, name: str):
        train, val = parts[target]
        model = regressors(**sizes)[name]().setLabelCol(target).fit(train)
        return model, metrics.regression_report(model.transform(val), target, "prediction").first()

    found = side_by_side(spark, [lambda cell=cell: fitted(*cell) for cell in cells], at_once)
    best = {}
    for (target, name), (model, row) in zip(cells, found):
        if target not in best or row["r2"] > best[target][0]:
            best[target] = (row["r2"], name, model)
    figures = metrics.regression_report(data.limit(0).withColumn("prediction", F.lit(0.0)), targets[0], "prediction").schema
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in figures), "target string", "method string"])
    report = spark.createDataFrame([(*row, *cell) for cell, (_, row) in zip(cells, found)], schema)
    return report, {t: (name, model, design) for t, (_, name, model) in best.items()}


def experts(train: DataFrame, cluster: str, make: Callable[[], Estimator], least: int = 40) -> Mapping:
    """A model per cluster of at least ``least`` rows, and under None the model of all rows."""
    sizes = {r[0]: r[1] for r in train.groupBy(cluster).count().collect()}
    models = {c: make().fit(train.where(F.col(cluster) == c)) for c, n in sizes.items() if n >= least and train.where(F.col(cluster) == c).select("label").distinct().count() > 1}
    return {None: make().fit(train), **models}


def dispatch(rows: DataFrame, cluster: str, models: Mapping) -> DataFrame:
    """Each row's prediction by its cluster's expert, else by the common model."""
    known = [c for c in models if c is not None]
    rest = rows.where(~F.coalesce(F.col(cluster).isin(known), F.lit(False))) if known else rows
    out = models[None].transform(rest).withColumn("expert", F.lit("common"))
    for c in known:
        out = out.unionByName(models[c].transform(rows.where(F.col(cluster) == c)).withColumn("expert", F.lit(f"cluster {c}")), allowMissingColumns=True)
    return out


def phenotypes(embeddings: DataFrame, columns: Sequence[str], k: int = 3, person: str = "participant_id") -> DataFrame:
    """(person, cluster) by k-means on scaled embeddings."""
    design = Design(embeddings, columns)
    data = design(embeddings)
    model = KMeans(k=k, maxIter=30, seed=SEED, initMode="k-means||").fit(data)
    return model.transform(data).select(person, F.col("prediction").alias("cluster"))


def participant_embeddings(rows: DataFrame, columns: Sequence[str], person: str = "participant_id") -> DataFrame:
    """Mean of each feature per participant, the mean of all rows where a participant has none."""
    own = rows.groupBy(person).agg(*[F.avg(c).alias(c) for c in columns])
    whole = rows.agg(*[F.avg(c).alias(f"all_{c}") for c in columns])
    return own.join(F.broadcast(whole)).select(person, *[F.coalesce(c, f"all_{c}", F.lit(0.0)).alias(c) for c in columns])


def nearest_centroid(rows: DataFrame, columns: Sequence[str], centroids: Mapping[int, Sequence[float]]) -> DataFrame:
    """Index and squared distance of the nearest of a few fixed centroids; ties go to the first."""
    far = [sum(((F.col(c) - x) * (F.col(c) - x) for c, x in zip(columns, centre)), F.lit(0.0)) for centre in centroids.values()]
    best = F.least(*far)
    choice = F.lit(None).cast("int")
    for index, d in reversed(list(zip(centroids, far))):
        choice = F.when(d == best, F.lit(index)).otherwise(choice)
    return rows.withColumns({"cluster": choice, "distance": best})


def predict_phase(rows: DataFrame, design: Design, model, hormones: Mapping | None = None) -> DataFrame:
    """Prediction, public label and the list of imputed predictors per row.

    Missing hormones are first predicted by their regressors, then other gaps take training medians.
    """
    for target, (_, regressor, own) in (hormones or {}).items():
        guessed = regressor.transform(own(rows)).withColumn(target, F.coalesce(F.col(target), F.col("prediction")))
        rows = guessed.select(*rows.columns, F.when(F.lit(True), F.col(target)).alias("__t")).drop(target).withColumnRenamed("__t", target)
    gaps = F.array_compact(F.array(*[F.when(F.col(p).isNull(), F.lit(p)) for p in design.predictors]))
    named = F.element_at(F.array(*[F.lit("Ovulatory" if p == "Fertility" else p) for p in PHASES]), (F.col("prediction") + 1).cast("int"))
    return model.transform(design(rows.withColumn("imputed", gaps))).withColumn("phase_predicted", named)
