"""Toxicity scores from gradient-boosted trees over dense features, calibrated by isotonic regression.

The lexicon is learned: words that labelled toxic documents hold far more often than others, by a
Chernoff bound that stays significant over all words tried. Features of a document are the densities
of lexicon hits, how near they stand to second-person words, the shares of capitals, punctuation and
exclamation, and how much is obfuscated (``st*pid``, ``1diot``, ``moooron``). Lexicon and trees are fitted
on three quarters of the training rows, the calibration on the rest.

Training uses at most ``TRAIN_DOCS`` labelled documents outside the held-out fold, the first by a hash
of the id. Labels, ids, language and source are no inputs of a score.

Defined cases: a null or empty text has features of 0 and is scored like any other. A null id is in
the fold of the empty text and never labelled. Repeated rows are scored each; of several labels for
one id the largest counts. Without both labels among the training rows every score is the share of
toxic ones (0 without rows). An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daylark.llm.common import crc_bucket, small_side, stored
from daylark.llm.tokens import WordTable

TRAIN_DOCS, LEXICON_WORDS, THRESHOLD = 20_000, 500, 0.7
FOLDS, HELD_OUT = 3, 1
NEAR_WORDS = 6
FEATURES = (
    "hit_density", "hits", "weight_density", "top_weight", "near_second_person", "capitals", "punctuation",
    "exclamations", "obfuscated_density", "obfuscated_hits", "log_words",
)
# Second-person words of several languages, and characters that stand for letters.
SECOND_PERSON = frozenset(
    "you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine deinen ihr euch euer "
    "usted ustedes ti tú vosotros vuestro su".split()
)
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_INNER = re.compile(r"[\W_]+")
_LONG = re.compile(r"(.)\1{2,}")
_HIDES = re.compile(r"\w[*@$!.\-_0-9]+\w*[^\W\d_]|(.)\1{2,}")


def plain(word: str) -> str:
    """Lower case without punctuation at the ends."""
    return _EDGE.sub("", word.lower())


def revealed(word: str) -> set[str]:
    """What an obfuscated word may stand for: letters for look-alikes, nothing for marks, runs shortened."""
    own, found = plain(word), set()
    for low in (word.lower(), own):
        for text in (_INNER.sub("", low.translate(LEET)), _INNER.sub("", low)):
            found |= {_LONG.sub(r"\1", text), _LONG.sub(r"\1\1", text)}
    return found - {own}


@dataclass
class Lexicon:
    weights: dict[str, float]

    def of_word(self, raw: bytes) -> tuple[float, float, float, float]:
        """Weight of the word, whether obfuscated, weight of what it hides, whether second person."""
        word = raw.decode("utf-8", "replace")
        own = word.lower().strip(string.punctuation)
        if own.isalpha() and not _LONG.search(own):
            return self.weights.get(own, 0.0), 0.0, 0.0, float(own in SECOND_PERSON)
        own = plain(word)
        weight = self.weights.get(own, 0.0)
        hides = bool(_HIDES.search(own)) and any(c.isalpha() for c in own)
        hidden = 0.0 if weight else max((self.weights.get(w, 0.0) for w in revealed(word)), default=0.0)
        return weight, float(hides or hidden > 0), hidden, float(own in SECOND_PERSON)

    def describe(self, words: list[bytes]) -> np.ndarray:
        return np.array([self.of_word(w) for w in words], np.float32).reshape(-1, 4)


_UPPER = bytes(range(65, 91))
_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def features_of(raw: bytes, rows: np.ndarray, data: np.ndarray) -> list[float]:
    n = len(rows)
    if not n:
        return [0.0] * len(FEATURES)
    own = data[rows]
    hit = np.flatnonzero((own[:, 0] > 0) | (own[:, 2] > 0))
    weights = own[hit, 0] + own[hit, 2]
    second = np.flatnonzero(own[:, 3] > 0)
    near = 0
    if len(hit) and len(second):
        at = np.searchsorted(second, hit)
        left = np.abs(hit - second[np.maximum(at - 1, 0)])
        right = np.abs(hit - second[np.minimum(at, len(second) - 1)])
        near = int((np.minimum(left, right) <= NEAR_WORDS).sum())
    size = len(raw)
    return [
        100 * len(hit) / n,
        float(min(len(hit), 20)),
        float(100 * weights.sum() / n),
        float(weights.max(initial=0.0)),
        near / max(1, len(hit)),
        (size - len(raw.translate(None, _UPPER))) / size,
        (size - len(raw.translate(None, _MARKS))) / size,
        (raw.count(b"!") + raw.count(b"?")) / n,
        float(100 * own[:, 1].sum() / n),
        float(min(20, (own[:, 2] > 0).sum())),
        math.log1p(n),
    ]


def featurize(docs: DataFrame, lexicon: Lexicon, keys: list[str], text_col: str = "text") -> DataFrame:
    """``keys`` with one double per feature."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    wanted = docs.select(*keys, F.col(text_col).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keys).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordTable(shared.value.describe, 4)
        for batch in batches:
            out = []
            for at in range(0, batch.num_rows, 1000):
                raws = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(len(keys)).slice(at, 1000).to_pylist()]
                for raw, rows in zip(raws, table.index([raw.split() for raw in raws])):
                    out.append(features_of(raw, rows, table.data))
            made = [pa.array(list(c), pa.float64()) for c in (zip(*out) if out else [()] * len(FEATURES))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *made], names=[*keys, *FEATURES])

    return wanted.mapInArrow(run, f"{schema}, " + ", ".join(f"{f} double" for f in FEATURES))


def training_labels(labels: DataFrame, id_col: str, label_col: str, most: int = TRAIN_DOCS) -> DataFrame:
    """(id, toxic) of at most ``most`` labelled ids outside the held-out fold."""
    rows = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).dropna()
    rows = rows.where(crc_bucket("id", FOLDS) != HELD_OUT).groupBy("id").agg(F.max("toxic").alias("toxic"))
    return rows.orderBy(F.xxhash64("id", F.lit(11)), "id").limit(most)


def learn_lexicon(docs: DataFrame, most: int = LEXICON_WORDS) -> Lexicon:
    """Words of ``docs`` (text, toxic) that toxic rows hold significantly more often, with their log odds."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list[int]] = {}
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for word in {plain(w) for w in (text or "").split()} - {""}:
                    sums.setdefault(word, [0, 0])[int(toxic > 0)] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.string()), *(pa.array([v[k] for v in sums.values()], pa.int64()) for k in (0, 1))],
            names=["word", "clean", "toxic"],
        )

    n_toxic, n_all = docs.agg(F.sum("toxic"), F.count(F.lit(1))).first()
    if not n_toxic or n_toxic == n_all:
        return Lexicon({})
    rate = n_toxic / n_all
    counts = docs.select("text", "toxic").mapInArrow(words, "word string, clean long, toxic long")
    counts = counts.groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counts = stored(counts.where("toxic + clean >= 3"), "word-labels")
    tried = max(1, counts.count())
    share = F.col("toxic") / (F.col("toxic") + F.col("clean"))
    other = F.when(share < 1, (1 - share) * F.log((1 - share) / F.lit(1 - rate))).otherwise(F.lit(0.0))
    bound = (F.col("toxic") + F.col("clean")) * (F.when(share > 0, share * F.log(share / F.lit(rate))).otherwise(F.lit(0.0)) + other)
    odds = F.log((F.col("toxic") + 0.5) / F.lit(n_toxic + 1.0)) - F.log((F.col("clean") + 0.5) / F.lit(n_all - n_toxic + 1.0))
    found = counts.where((share > rate) & (bound > math.log(tried))).select("word", odds.alias("odds")).where("odds > 1")
    return Lexicon({r["word"]: r["odds"] for r in found.orderBy(F.desc("odds"), "word").limit(most).collect()})


def score_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic"
) -> DataFrame:
    """id, held_out, score and predicted per row of ``docs`` (see the module's defined cases)."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    chosen = stored(training_labels(labels, id_col, label_col), "labels")
    sample = stored(rows.join(small_side(chosen), "id").select("id", "text", "toxic"), "labelled")
    calibrates = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(4)) == 0
    lexicon = learn_lexicon(sample.where(~calibrates))
    features = stored(featurize(rows, lexicon, ["id"]), "features")
    held_out = (crc_bucket("id", FOLDS) == HELD_OUT).alias("held_out")
    n_toxic, n_all = sample.agg(F.sum("toxic"), F.count(F.lit(1))).first()
    to_vector = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    known = to_vector.transform(featurize(sample, lexicon, ["id", "toxic"]))
    known = stored(known.select("id", "features", F.col("toxic").cast("double").alias("label")), "known")
    fit, rest = known.where(~calibrates), known.where(calibrates)
    enough = n_toxic and n_toxic < n_all and fit.select("label").distinct().count() == 2 and not rest.isEmpty()
    if not enough:
        score = F.lit(float(n_toxic or 0) / max(1, n_all))
        return features.select(F.col("id").alias(id_col), held_out, score.alias("score"), (score >= THRESHOLD).cast("int").alias("predicted"))
    trees = GBTClassifier(maxIter=20, maxDepth=3, stepSize=0.2, seed=1).fit(fit.coalesce(4))
    probability = vector_to_array(F.col("probability"))[1].alias("raw")
    curve = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="score").fit(
        trees.transform(rest).select(probability, "label")
    )
    scored = curve.transform(trees.transform(to_vector.transform(features)).select("id", probability))
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("score")))
    return scored.select(F.col("id").alias(id_col), held_out, score.alias("score"), (score >= THRESHOLD).cast("int").alias("predicted"))
