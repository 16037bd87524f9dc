"""Language-model scores by logistic context mixing over the bits of a text.

A lower-cased text and its end are coded in order. Bytes are written in units of six bits: each of the 63
most frequent bytes of the training documents is one unit, another byte an escape and two units. A unit is
six binary decisions. For each decision six predictors look up log odds under a hashed context: the last
1, 2, 3, 4 and 6 units, across words, and the beginning of the current word. They are combined by weights
that a gate selects by the bit's place in its unit and by how often training met the longest context and
the word's beginning. After each bit the weights take a gradient step, and an adaptive table over the
mixed odds and the bit's place, which refines the probability, moves towards the bit. The score is the log probability of the whole text and its end; ``bits_per_byte`` follows.

A text is coded in blocks of ``BLOCK`` units. Each block sees the units before it, starts from the
fitted weights and refining table, and takes its first unit as a word's beginning; so blocks of all
texts of a batch are coded side by side, and a score depends on nothing but the text and the model.

What is gathered: counts of every word of all training documents, by a shuffle on the word (for the
base score), and counts of every unit in its three contexts over all training documents, in hashed
tables of 2^``MOST_BITS`` rows at most, smaller where the training text is. All but one in ``MIXING_SHARE``
of the training documents fill the tables first; that share (by a hash of the id, so it grows with the
input) then sets the weights and the refining table, and is added to the tables. Sums are of integers,
so that no result depends on how rows are dealt to tasks.

Defined cases: a null text counts as empty, and an empty text is its end alone. Null ids pass through
and are in the fold of the empty text. Repeated rows are scored each. Words and texts may be of any
length. An empty table gives an empty result; without training rows all counts are 0 and the model
knows nothing but its priors. Columns other than the id and the text are not read.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import compress, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daylark.llm.common import SPACES, crc_bucket, least_count, stored

FOLDS, HELD_OUT = 7, 2
#: One in so many training documents sets the mixing weights.
MIXING_SHARE = 16
ORDERS = (1, 2, 3, 4, 6)
BACK, PREDICTORS = max(ORDERS), len(ORDERS) + 1
#: Rows of each predictor's table as powers of two, at most; the last one is for beginnings of words.
MOST_BITS = (12, 16, 19, 20, 20, 20)
BLOCK, LANES, LANE_STEP, SLAB = 2048, 4608, 128, 16
STEPS = 17  #: buckets of the refining table over log odds from -8 to 8
PRIOR = 0.05
#: Log odds are kept as whole numbers of this part.
UNIT = 16
#: Gates: whether a row was met at least so often, for the longest context and for the word's beginning.
SEEN = (1, 4)
GATES = (len(SEEN) + 1) ** 2
FIT_RATE, RATE, REFINE_RATE = 0.02, 0.01, 0.02
SLICE = 1 << 16  #: table entries in one row of a table of counts
HEAD_WORDS = 200_000
_C = np.uint32(0x9E3779B1)
_END = 0xFF  # no byte of UTF-8; stands for the end of the text
ESCAPE = 63


class Alphabet:
    """Units of bytes, from how often each byte occurs (256 counts): ties go to the smaller byte."""

    def __init__(self, counts: np.ndarray):
        self.rank = np.empty(256, np.uint8)
        self.rank[np.lexsort((np.arange(256), -np.asarray(counts)))] = np.arange(256, dtype=np.uint8)
        self.space = np.zeros(64, bool)
        self.space[[r for r in self.rank[list(SPACES)] if r < ESCAPE]] = True

    def units(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The units of bytes, and which bytes take three units."""
        rank = self.rank.take(data)
        rare = np.flatnonzero(rank >= ESCAPE)
        first, left = rare + 2 * np.arange(len(rare)), rank[rare] - ESCAPE
        out, whole = np.empty(len(data) + 2 * len(rare), np.uint8), np.ones(len(data) + 2 * len(rare), bool)
        whole[first + 1] = whole[first + 2] = False
        out[whole] = np.minimum(rank, ESCAPE, out=rank)
        out[first + 1], out[first + 2] = left >> 6, left & 63
        return out, rare


def table_bits(n_bytes: int) -> tuple[int, ...]:
    """Rows of the tables for so many bytes of training text: about one row a byte until the bound."""
    return tuple(min(most, max(8, n_bytes.bit_length())) for most in MOST_BITS)


@dataclass
class Places:
    """Where contexts are found in the tables: the right shift of a hash and the first row, per predictor."""

    bits: tuple[int, ...]

    def __post_init__(self):
        self.shift = np.array([32 - b for b in self.bits], np.uint32)[:, None]
        self.first = np.cumsum([0, *(1 << b for b in self.bits[:-1])]).astype(np.uint32)[:, None]
        self.entries = 8 * sum(1 << b for b in self.bits)

    def entry(self, contexts: np.ndarray, entries: int, which: np.ndarray, out: np.ndarray) -> None:
        """Put where an entry of each context is in a table whose rows have so many of them to ``out``; contexts are used up."""
        contexts >>= self.shift
        contexts += self.first
        contexts *= np.uint32(entries)
        contexts += which
        out[:] = contexts


def halves(contexts: np.ndarray, unit: np.ndarray, both: np.ndarray, half: np.ndarray) -> None:
    """Contexts of the units' high halves, then of their low halves given the high ones, and the halves (three bits); put to the last two."""
    m = len(unit)
    np.right_shift(unit, np.uint32(3), out=half[:m])
    np.add(half[:m], np.uint32(1), out=half[m:])
    both[:, :m], low = contexts, both[:, m:]
    np.add(contexts, half[m:], out=low)
    low *= _C
    np.bitwise_and(unit, np.uint32(7), out=half[m:])


def blocks(texts: list[bytes], alphabet: Alphabet) -> Iterator[tuple[np.ndarray, Iterator[tuple[int, np.ndarray, np.ndarray]]]]:
    """Groups of blocks of like length: the number of each block's text, and the steps of the group.

    A step is one unit of every block that is long enough (the first n of the group): n, contexts, units;
    the latter two may go on beyond n, up to a multiple of ``LANE_STEP``.
    """
    end = bytes([_END])
    data, rare = alphabet.units(np.frombuffer(end.join([*texts, b""]), np.uint8))
    at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)])
    at += 2 * np.searchsorted(rare, at)
    size = np.diff(at)
    whole = np.zeros(len(data) + BACK * len(texts), np.uint8)  # every text after ``BACK`` zeros
    first = at[:-1] + BACK * np.arange(1, len(texts) + 1)
    for k, n in enumerate(size.tolist()):
        whole[first[k] : first[k] + n] = data[at[k] : at[k + 1]]
    number = -(-size // BLOCK)
    owner = np.repeat(np.arange(len(texts)), number)
    offset = (np.arange(len(owner)) - np.repeat(np.cumsum(number) - number, number)) * BLOCK
    start, length = first[owner] + offset, np.minimum(BLOCK, size[owner] - offset)
    order = np.argsort(-length, kind="stable")
    for k in range(0, len(order), LANES):
        own = order[k : k + LANES]
        yield owner[own], steps(whole, start[own], length[own], alphabet.space)


def steps(whole: np.ndarray, start: np.ndarray, length: np.ndarray, is_space: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    longest = int(length[0])
    alive = np.searchsorted(-length, -np.arange(longest))
    word = np.zeros(len(start), np.uint32)
    lanes = lambda t: min(len(start), -(-int(alive[t]) // LANE_STEP) * LANE_STEP)
    go_on = (~is_space).astype(np.uint32) * _C
    most = -1
    for slab in range(0, longest, SLAB):
        end = min(slab + SLAB, longest)
        if most != lanes(slab):  # buffers, made anew where fewer blocks are left
            most = lanes(slab)
            where, near = np.empty((SLAB + BACK, most), np.intp), np.empty((SLAB + BACK, most), np.uint8)
            unit, after, goes_on = np.empty((3, SLAB + BACK, most), np.uint32)
            contexts, mix = np.empty((SLAB, PREDICTORS, most), np.uint32), np.empty((SLAB, most), np.uint32)
        np.add(start[:most], np.arange(slab - BACK, slab + SLAB)[:, None], out=where)
        whole.take(where, mode="clip", out=near)
        unit[:] = near
        np.add(unit, np.uint32(1), out=after)  # what a unit adds to a hash
        go_on.take(near, mode="clip", out=goes_on)
        np.multiply(after[BACK - 1 : BACK - 1 + SLAB], _C, out=mix)
        contexts[:, 0] = mix
        k = 1
        for back in range(2, BACK + 1):
            mix += after[BACK - back : BACK - back + SLAB]
            mix *= _C
            if back == ORDERS[k]:
                contexts[:, k] = mix
                k += 1
        for t in range(slab, end):
            m, at = lanes(t), t - slab
            now = word[:m]
            if t:
                now += after[at + BACK - 1, :m]
                now *= goes_on[at + BACK - 1, :m]
            contexts[at, -1, :m] = now
            yield int(alive[t]), contexts[at, :, :m], unit[at + BACK, :m]


def add_counts(counts: np.ndarray, places: Places, texts: list[bytes], alphabet: Alphabet) -> None:
    """Count each unit of the texts in its contexts: its high half, and its low half after the high one."""
    for owner, group in blocks(texts, alphabet):
        ones = np.ones(2 * PREDICTORS * len(owner), np.int32)
        m = -1
        for n, contexts, unit in group:
            if m != n:
                m = n
                both, half, at = np.empty((PREDICTORS, 2 * n), np.uint32), np.empty(2 * n, np.uint32), np.empty((PREDICTORS, 2 * n), np.intp)
            halves(contexts[:, :n], unit[:n], both, half)
            places.entry(both, 8, half, at)
            np.add.at(counts, at.ravel(), ones[: at.size])


def log_odds(counts: np.ndarray) -> np.ndarray:
    """Per row of 8 counts: log odds of one against zero at the 7 inner nodes, from entry 1 on; how often it was met in entry 0."""
    leaves = counts.reshape(-1, 8).astype(np.float32)
    out = np.zeros(leaves.shape, np.int8)
    level = leaves
    for depth in (2, 1, 0):
        pairs = level.reshape(len(leaves), -1, 2)
        odds = np.log((pairs[:, :, 1] + np.float32(PRIOR)) / (pairs[:, :, 0] + np.float32(PRIOR)))
        out[:, 1 << depth : 2 << depth] = np.rint(np.clip(odds * UNIT, -127, 127))
        level = pairs.sum(axis=2)
    out[:, 0] = np.searchsorted(SEEN, level[:, 0], side="right")
    return out


@dataclass
class Model:
    """Log odds (``Places.entries``), start weights (place in the half, gate, predictor, half) and refining table (6 * STEPS)."""

    alphabet: Alphabet
    bits: tuple[int, ...]
    odds: np.ndarray
    weights: np.ndarray
    refine: np.ndarray

    def __getstate__(self) -> dict:
        return {k: v for k, v in vars(self).items() if k != "paths"}

    @cached_property
    def paths(self) -> np.ndarray:
        """Per row and first two bits of a half, in four bytes: log odds at the three nodes on the way, and how often the row was met."""
        rows = self.odds.reshape(-1, 8)
        out = np.empty((len(rows), 4, 4), np.int8)
        for two in range(4):
            for place, entry in enumerate((1, 2 + (two >> 1), 4 + two, 0)):
                out[:, two, place] = rows[:, entry]
        return out.view(np.int32).ravel()

    def log10(self, texts: list[bytes]) -> np.ndarray:
        """log10 probability of each text and its end."""
        total = np.zeros(len(texts))
        for owner, group in blocks(texts, self.alphabet):
            total += np.bincount(owner, Coder(self, len(owner), RATE).code(group), len(texts))
        return total / math.log(10)


def fresh(alphabet: Alphabet, bits: tuple[int, ...], odds: np.ndarray) -> Model:
    weights = np.full((3, GATES, PREDICTORS, 2), 1.5 / PREDICTORS / UNIT, np.float32)
    middle = 1 / (1 + np.exp(-np.linspace(-8, 8, STEPS)))
    return Model(alphabet, bits, odds, weights, np.tile(middle, 6).astype(np.float32))


#: Per half of a unit: 1 for a zero bit or -1 for a one, by place; no bit at the fourth place. Four floats in one item.
_SIGNS = np.array([[*(1 - 2 * (v >> (2 - place) & 1) for place in range(3)), 0] for v in range(8)], np.float32).view(np.complex128).ravel()


class Coder:
    """Codes a group of blocks side by side; each block has its own weights and refining table.

    All six bits of a unit are coded in one go, as each place of either half has its own weights and
    buckets. The three places of a half and a fourth, at which nothing is mixed or learnt, lie side by side:
    four log odds come as one item of four bytes, four weights or signs as one of sixteen.
    """

    def __init__(self, model: Model, lanes: int, rate: float):
        self.paths, self.places, self.rate, self.lanes, self.m = model.paths, Places(model.bits), np.float32(rate / UNIT / UNIT), lanes, -1
        self.weights = np.zeros((GATES, PREDICTORS, 2, lanes, 4), np.float32)
        self.weights[..., :3] = np.moveaxis(model.weights, 0, -1)[..., None, :]
        self.refine = np.zeros((lanes, 2, 4, STEPS), np.float32)
        self.refine[:, :, :3] = model.refine.reshape(2, 3, STEPS) - np.float32(0.5)
        self.spent = np.zeros(lanes)

    def learnt(self) -> np.ndarray:
        """Weights as those of a model, per block (the last axis)."""
        return np.moveaxis(self.weights[..., :3], -1, 0)

    def lay_out(self, m: int) -> None:
        """Where the weights and buckets of m units' halves are, and buffers."""
        self.m = m
        self.buckets = (np.arange(m)[:, None] * 8 + np.array([[[0]], [[4]]]) + np.arange(4)).ravel() * STEPS
        self.own = (np.arange(m) + self.lanes * (np.array([[0], [1]]) + 2 * np.arange(PREDICTORS)[:, None, None])).reshape(PREDICTORS, 2 * m)
        self.both, self.half = np.empty(self.own.shape, np.uint32), np.empty(2 * m, np.uint32)
        self.found, self.at, self.w = np.empty(self.own.shape, np.int32), np.empty_like(self.own), np.empty(self.own.shape, np.complex128)
        self.signs, self.bucket, self.refined = np.empty(2 * m, np.complex128), np.empty(8 * m, np.intp), np.empty(8 * m, np.float32)
        self.x, self.wx = np.empty((2, PREDICTORS, 8 * m), np.float32)
        self.z, self.e = np.empty((2, 8 * m), np.float32)

    def code(self, group, outcomes: np.ndarray | None = None) -> np.ndarray:
        """Natural log probability of each block; ``outcomes`` (2, 6 * STEPS) counts bits per bucket."""
        keep, step, width = np.float32(1 - REFINE_RATE), np.float32(REFINE_RATE / 2), np.float32((STEPS - 1) / 16)
        middle, one = np.float32((STEPS - 1) / 2 + 0.5), np.float32(1)
        weights, refine = self.weights.view(np.complex128).ravel(), self.refine.ravel()  # views
        for n, contexts, unit in group:
            m = len(unit)
            if self.m != m:
                self.lay_out(m)
                found, at, x, wx, z, e, bucket, refined = self.found, self.at, self.x, self.wx, self.z, self.e, self.bucket, self.refined
                w, sign = self.w.view(np.float32), self.signs.view(np.float32)
            halves(contexts, unit, self.both, self.half)
            _SIGNS.take(self.half, out=self.signs, mode="clip")
            self.half >>= np.uint32(1)
            self.places.entry(self.both, 4, self.half, at)
            self.paths.take(at, out=found, mode="clip")
            x[:] = found.view(np.int8)
            seen = found[-2:] >> np.int32(24)
            seen[0] *= len(SEEN) + 1
            seen[0] += seen[1]
            seen[0] *= 2 * PREDICTORS * self.lanes
            np.add(self.own, seen[0], out=at)
            weights.take(at, out=self.w, mode="clip")
            np.multiply(w, x, out=wx)
            np.add(wx[0], wx[1], out=z)
            for k in range(2, PREDICTORS):
                z += wx[k]
            np.clip(z, np.float32(-8), np.float32(8), out=z)
            np.multiply(z, width, out=e)
            e += middle
            bucket[:] = e
            bucket += self.buckets
            if outcomes is not None:
                own, bits = (part.reshape(2, m, 4)[:, :n, :3] for part in (bucket % (8 * STEPS), sign))
                own = own - STEPS * np.array([[[0]], [[1]]])  # without the fourth place of the first half
                outcomes += np.stack([np.bincount(own[bits == side], minlength=6 * STEPS) for side in (1, -1)])
            z *= sign  # odds against the bit
            np.exp(z, out=e)
            e += one
            np.reciprocal(e, out=e)  # the probability of the bit
            refine.take(bucket, out=refined, mode="clip")
            np.multiply(refined, sign, out=z)
            np.subtract(e, z, out=z)
            z += np.float32(0.5)  # twice the probability of the bit after refining
            chance = z[::4] * z[1::4]
            chance *= z[2::4]
            np.subtract(one, e, out=e)
            e *= self.rate
            e *= sign
            e.reshape(2, m, 4)[:, n:] = 0  # blocks that have ended learn no more
            refined *= keep
            sign *= step
            refined -= sign
            refine[bucket] = refined
            x *= e
            w -= x
            weights[at] = self.w
            self.spent[:n] += np.log(chance[:n] * chance[m : m + n]) - 6 * math.log(2)
        return self.spent


def lowered(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").lower()


def portions(column, most: int = 8 << 20) -> Iterator[list[bytes]]:
    """The texts of an Arrow column, lower-cased, in lists of about ``most`` bytes or one text."""
    out, size = [], 0
    for text in column:
        out.append(lowered(text.as_py()))
        size += len(out[-1])
        if size >= most:
            yield out
            out, size = [], 0
    if out:
        yield out


def word_counts(docs: DataFrame) -> DataFrame:
    """(token, n) over (text): occurrences of words; tokens of a space and a byte count that byte, 0xFF the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        shape = np.zeros(256, np.int64)

        def drain():
            made = [pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())]
            found.clear()
            return pa.RecordBatch.from_arrays(made, names=["token", "n"])

        for batch in batches:
            for text in batch.column(0):
                raw = lowered(text.as_py())
                found.update(raw.split())
                shape += np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
                shape[_END] += 1
                if len(found) > 400_000:
                    yield drain()
        for k in np.flatnonzero(shape).tolist():
            found[b" " + bytes([k])] = int(shape[k])
        yield drain()

    return docs.select("text").mapInArrow(run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


def sliced(sums: np.ndarray) -> pa.RecordBatch:
    """The parts of a table that are not all zero, packed."""
    own = [(k, sums[k : k + SLICE]) for k in range(0, len(sums), SLICE)]
    own = [(k // SLICE, zlib.compress(part.tobytes(), 1)) for k, part in own if part.any()]
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in own], pa.int64()), pa.array([d for _, d in own], pa.binary())], names=["slice", "sums"])


def added(rows: DataFrame, kind: type, tasks: int, then=None) -> DataFrame:
    """(slice, sums): the parts of ``tasks`` partitions added up per slice, first within shares of 16 of them."""

    def add(kind: type, then=None):
        def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
            total = np.zeros(1, np.int64)
            for data in group["sums"]:
                total = total + np.frombuffer(zlib.decompress(data), kind)
            return pd.DataFrame({"slice": [key[0]], "sums": [zlib.compress((then(total) if then else total).tobytes(), 1)]})

        return run

    if tasks > 16:
        shares = rows.withColumn("share", F.floor(F.spark_partition_id() / 16))
        rows, kind = shares.groupBy("slice", "share").applyInPandas(add(kind), "slice long, sums binary"), np.int64
    return rows.groupBy("slice").applyInPandas(add(kind, then), "slice long, sums binary")


def collected(rows: DataFrame, entries: int, kind: type) -> np.ndarray:
    out = np.zeros(entries, kind)
    for k, data in rows.collect():
        own = np.frombuffer(zlib.decompress(data), kind)
        out[k * SLICE : k * SLICE + len(own)] = own
    return out


def fit(docs: DataFrame, shape: np.ndarray) -> Model:
    """The model of the training documents ``docs`` (text, mixes), which hold so many of each byte."""
    spark = docs.sparkSession
    alphabet, n_bytes = Alphabet(shape), int(shape.sum())
    bits = table_bits(n_bytes)
    places = Places(bits)
    tasks = max(1, min(n_bytes >> 22, max(spark.sparkContext.defaultParallelism, n_bytes >> 27)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(places.entries, np.int32)
        for batch in batches:
            for texts in portions(batch.column(0)):
                add_counts(sums, places, texts, alphabet)
        yield sliced(sums)

    made = "slice long, sums binary"
    first = stored(added(docs.where("not mixes").select("text").coalesce(tasks).mapInArrow(count, made), np.int32, tasks), "counts")
    mixing = stored(docs.where("mixes").select("text"), "mixing").coalesce(max(1, tasks // 4))
    as_odds = lambda rows: collected(added(rows, np.int64, 1, log_odds), places.entries, np.int8)
    model = fresh(alphabet, bits, as_odds(first))
    fixed = 1 << 24
    n_weights = model.weights.size
    shared = spark.sparkContext.broadcast(model)

    def adjust(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of the weights at the ends of the blocks by units, of units, and of bits per bucket of the refining table."""
        moved, n_units, outcomes = np.zeros(n_weights, np.int64), 0, np.zeros((2, 6 * STEPS), np.int64)

        def measured(group, size):
            for n, contexts, unit in group:
                size[:n] += 1
                yield n, contexts, unit

        for batch in batches:
            for texts in portions(batch.column(0)):
                for owner, group in blocks(texts, alphabet):
                    coder, size = Coder(shared.value, len(owner), FIT_RATE), np.zeros(len(owner), np.int64)
                    coder.code(measured(group, size), outcomes)
                    moved += (np.rint(coder.learnt().astype(np.float64) * fixed).astype(np.int64) * size).sum(axis=-1).ravel()
                    n_units += int(size.sum())
        yield sliced(np.concatenate([moved, [n_units], outcomes.ravel()]))

    sums = collected(added(mixing.mapInArrow(adjust, made), np.int64, tasks), n_weights + 1 + 12 * STEPS, np.int64)
    if sums[n_weights]:
        zeros, ones = sums[n_weights + 1 :].reshape(2, -1)
        model.weights = (sums[:n_weights] / fixed / sums[n_weights]).reshape(model.weights.shape).astype(np.float32)
        model.refine = ((ones + 20 * model.refine) / (ones + zeros + 20)).astype(np.float32)
    shared.unpersist()
    second = added(mixing.mapInArrow(count, made), np.int32, tasks)
    model.odds = as_odds(first.unionAll(second))
    return model


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte per row of ``docs``."""
    spark = docs.sparkSession
    held_out = crc_bucket("id", FOLDS) == HELD_OUT
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    train = rows.where(~held_out).select("text", (F.pmod(F.xxhash64("id", F.lit(6)), F.lit(MIXING_SHARE)) == 0).alias("mixes"))
    counts = stored(word_counts(train), "word-counts")
    shape = np.zeros(256, np.int64)
    for token, n in counts.where(F.col("token").startswith(F.lit(b" "))).collect():
        shape[token[1]] = n
    words, ends = counts.where(~F.col("token").startswith(F.lit(b" "))), int(shape[_END])
    of_words, types = words.agg(F.sum("n"), F.count(F.lit(1))).first()
    n_train, n_types = (of_words or 0) + ends, types + (ends > 0)
    head = words.where(F.col("n") >= least_count(words, "n", HEAD_WORDS)).select("token", "n").toArrow()
    known = spark.sparkContext.broadcast((head.column(0).to_pylist(), head.column(1).to_numpy(), ends))
    model = spark.sparkContext.broadcast(fit(train, shape))
    per_token = math.log10(n_train + n_types + 1)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, n, ends = known.value
        at, base, end_base = {t: k for k, t in enumerate(tokens)}, np.log10(np.append(n, 0) + 1.0), math.log10(ends + 1)
        one = np.zeros(1, np.int64)
        for batch in batches:
            start = 0
            for texts in portions(batch.column(2)):
                part = batch.slice(start, len(texts))
                start += len(texts)
                score = model.value.log10(texts)
                tokens, times, heads, sums = [], [], [], []
                for key, raw, lm in zip(part.column(0).to_pylist(), texts, score.tolist()):
                    words = raw.split()
                    found = np.fromiter(map(at.get, words, repeat(-1)), np.int64, len(words))
                    unknown = found < 0
                    others = Counter(compress(words, unknown.tolist()))
                    heads.append(len(tokens))
                    tokens.append(b" %d" % key)  # no word: matches nothing, and lands with its own hash
                    tokens += others
                    times += [one, np.fromiter(others.values(), np.int64, len(others))]
                    n_known = len(words) - np.count_nonzero(unknown)
                    sums.append((len(words) + 1, n_known + (end_base > 0), base[found].sum() + end_base, lm, len(raw) + 1))
                size = np.diff([*heads, len(tokens)])
                owner = np.repeat(np.arange(len(heads)), size)
                columns = np.zeros((5, len(tokens)))
                columns[:, heads] = np.array(sums, np.float64).reshape(-1, 5).T
                only_heads = np.ones(len(tokens), bool)
                only_heads[heads] = False
                made = [pa.array(columns[k].astype(np.int64) if k in (0, 1, 4) else columns[k], mask=only_heads if k == 0 else None) for k in range(5)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(owner)), part.column(1).take(pa.array(owner, mask=only_heads)), pa.array(tokens, pa.binary()),
                        pa.array(np.concatenate([np.zeros(0, np.int64), *times]).astype(np.int32)), *made,
                    ],
                    names=["key", "id", "token", "times", "n_tokens", "n_known", "base", "lm", "bytes"],
                )

    numbered = rows.select(F.monotonically_increasing_id().alias("key"), "id", "text")
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"key long, id {kind}, token binary, times int, n_tokens long, n_known long, base double, lm double, bytes long"
    joined = numbered.mapInArrow(look_up, schema).join(words, "token", "left")
    sums = joined.groupBy("key").agg(
        F.max("id").alias("id"),
        F.max("n_tokens").alias("n_tokens"),
        (F.sum("n_known") + F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0))).cast("long").alias("n_known"),
        (F.sum("base") + F.sum(F.coalesce(F.col("times") * F.log10(F.col("n") + 1.0), F.lit(0.0)))).alias("base"),
        F.sum("lm").alias("score"),
        F.max("bytes").alias("bytes"),
    )
    return sums.select(
        F.col("id").alias(id_col),
        held_out.alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * F.lit(per_token)).alias("base_score"),
        "score",
        (-F.col("score") / F.lit(math.log10(2)) / F.col("bytes")).alias("bits_per_byte"),
    )
