"""Phrase collocation mining by hierarchical pair naming.

Words that are frequent in their language get ids. A phrase of k words is the pair of the two phrases of
k - 1 words that overlap in it, so each level counts the pairs of ids at neighbouring positions, names the
frequent ones by a new id and puts that id in the texts' place of the pair's first. A pair's two ids are
parent pointers: its cuts are looked up along them, and a phrase is held in a longer one if it is a
parent of a frequent phrase. Only the next level has to be looked at for that, as a phrase between
two others occurs at least as often as the longer one.

Texts are kept as arrays of ids, in which a negative number stands for a break or infrequent words. Names are
put in their place by a broadcast of at most ``NAMES`` words or four times as many pairs, by a join beyond that.

Defined cases: a null text counts as empty, a null language is ``und``. Empty texts and pieces give no
words, repeated rows count as often as they occur, whole texts are counted, ties are ordered by
phrase. An empty table, or one without frequent words, gives an empty result. Columns other than the text
and the language aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daylark.llm.common import UPPER, stored
from daylark.llm.tokens import counted

LEAST, LONGEST, TOP, HELD_PERCENT, SCALE = 30, 4, 2000, 80, 2_000_000
#: Most words that are broadcast with their ids (some 100 bytes each), and a quarter of the pairs (16 bytes each).
NAMES = 1_000_000
BREAK, RARE = -1, -2
#: Pairs that a task gathers before it counts them and passes the counts on.
HELD_PAIRS = 2_000_000
#: Texts that a task works on at a time.
SLICE = 500
_CLEAN = bytes.maketrans(UPPER.encode() + b"\t" + b".,;:!?\n\x0b\x0c\r", UPPER.lower().encode() + b" " + b"\n" * 10)


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words of a text in order, and a line feed between pieces."""
    raw = (text or "").encode("utf-8", "surrogatepass").translate(_CLEAN)
    return list(filter(None, raw.replace(b"\n", b" \n ").split(b" ")))


def word_counts(texts: DataFrame) -> DataFrame:
    """(lang, phrase, f) of each word, and each language's number of words under the empty word."""

    def keys(batch: pa.RecordBatch):
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            yield lang, (w for w in words_of(text.as_py()) if w != b"\n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for langs, words, ns in counted(batches, keys):
            total: dict[str, int] = {}
            for lang, n in zip(langs, ns):
                total[lang] = total.get(lang, 0) + n
            made = [pa.array(langs + list(total)), pa.array(words + [b""] * len(total), pa.binary()).cast(pa.string()), pa.array(ns + list(total.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(made, names=["lang", "phrase", "f"])

    return texts.mapInArrow(run, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def numbered(rows: DataFrame, name: str) -> tuple[DataFrame, int]:
    """``rows`` stored with dense ids from 0, and their number."""
    kept = stored(rows.withColumn("id", F.monotonically_increasing_id()), name)
    part = F.shiftright("id", 33)
    first, offsets = 0, {}
    for p, n in sorted(map(tuple, kept.groupBy(part).count().collect())):  # one row for each partition that wrote the table
        offsets[p] = first - (p << 33)
        first += n
    if offsets:
        shift = F.element_at(F.map_from_arrays(F.array(*map(F.lit, offsets)), F.array(*[F.lit(x) for x in offsets.values()])), part)
        kept = kept.withColumn("id", F.col("id") + shift)
    return kept, first


def encoded(texts: DataFrame, vocabulary: DataFrame, size: int, most: int) -> DataFrame:
    """(ids) of each text: its words by their id."""
    if size > most:
        return _encoded_by_join(texts, vocabulary)
    tables: dict[str, dict[bytes, int]] = {}
    for row in vocabulary.select("lang", "phrase", "id").toLocalIterator():
        tables.setdefault(row[0], {b"\n": BREAK})[row[1].encode()] = row[2]
    shared = texts.sparkSession.sparkContext.broadcast(tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chain.from_iterable(map(_slices, batches)):
            out = []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                table, words = shared.value.get(lang), words_of(text.as_py())
                if table and len(words) > 1:
                    out.append(squeezed(np.fromiter((table.get(w, RARE) for w in words), np.int64, len(words))))
            yield from _batches(out)

    return texts.mapInArrow(run, "ids array<long>")


def squeezed(ids: np.ndarray) -> np.ndarray:
    """``ids`` with one negative entry for a run of them; empty without two neighbours."""
    if not len(ids):
        return ids
    pair = (ids[1:] >= 0) & (ids[:-1] >= 0)
    keep = np.append(False, pair) | np.append(pair, False)
    ends = np.append(True, keep[:-1]) & ~keep  # the first entry after a kept run stands for the gap
    out = np.where(keep, ids, BREAK)[keep | ends]
    return out if keep.any() else out[:0]


def _batches(arrays: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    arrays = [a for a in arrays if len(a)]
    for at in range(0, len(arrays), 2_000):
        yield pa.RecordBatch.from_arrays([pa.array(arrays[at : at + 2_000], pa.list_(pa.int64()))], names=["ids"])


def _encoded_by_join(texts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                words = words_of(text.as_py())
                for at in range(0, len(words), 100_000):
                    part = words[at : at + 100_000]
                    made = [pa.array([lang] * len(part)), pa.array([row] * len(part), pa.int64()), pa.array(range(at, at + len(part)), pa.int64())]
                    yield pa.RecordBatch.from_arrays([*made, pa.array(part, pa.binary()).cast(pa.string())], names=["lang", "row", "pos", "phrase"])

    rows = stored(texts.withColumn("row", F.monotonically_increasing_id()).select("lang", "row", "text"), "rows")
    words = rows.mapInArrow(run, "lang string, row long, pos long, phrase string")
    return _regrouped(words.join(vocabulary.select("lang", "phrase", "id"), ["lang", "phrase"]))


def _regrouped(found: DataFrame) -> DataFrame:
    """(ids) of each row from its (row, pos, id); positions that aren't there become a break."""
    placed = found.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("pos", "id"))).alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for pos, ids in zip(batch.column(0), batch.column(1)):
                pos, ids = (c.values.to_numpy() for c in (pos, ids))
                full = np.full(2 * len(pos), BREAK)
                at = np.arange(len(pos)) + np.cumsum(np.append(0, pos[1:] - pos[:-1] > 1))
                full[at] = ids
                out.append(squeezed(full[: at[-1] + 1]))
            yield from _batches(out)

    return placed.select(F.col("x.pos").alias("pos"), F.col("x.id").alias("ids")).mapInArrow(run, "ids array<long>")


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in parts of ``SLICE`` texts, which bounds the arrays made of them."""
    for at in range(0, len(batch), SLICE):
        yield batch.slice(at, SLICE)


def _flat(column: pa.Array) -> np.ndarray:
    """All arrays of a batch in one, with a break after each."""
    sizes = np.diff(column.offsets.to_numpy())
    ends = np.cumsum(sizes + 1) - 1
    out = np.full(int(sizes.sum()) + len(sizes), BREAK)
    inside = np.ones(len(out), bool)
    inside[ends] = False
    out[inside] = column.flatten().to_numpy()
    return out


def pair_counts(arrays: DataFrame, size: int, least: int) -> DataFrame:
    """(key, f) of the pairs of neighbouring ids with at least ``least`` occurrences; ``key`` is ``a * size + b``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, n = [], 0

        def counts():
            keys, f = np.unique(np.concatenate(waiting), return_counts=True)
            for at in range(0, len(keys), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + 100_000]), pa.array(f[at : at + 100_000])], names=["key", "f"])

        for batch in chain.from_iterable(map(_slices, batches)):
            ids = _flat(batch.column(0))
            both = (ids[:-1] >= 0) & (ids[1:] >= 0)
            waiting.append((ids[:-1] * size + ids[1:])[both])
            n += len(waiting[-1])
            if n > HELD_PAIRS:
                yield from counts()
                waiting, n = [], 0
        if n:
            yield from counts()

    return arrays.mapInArrow(run, "key long, f long").groupBy("key").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def renamed(arrays: DataFrame, names: DataFrame, size: int, count: int, most: int) -> DataFrame:
    """``arrays`` with each pair's id at the place of its first, from ``names`` (key, id) of ``count`` rows."""
    if count > most:
        rows = stored(arrays.withColumn("row", F.monotonically_increasing_id()), "rows")
        key = F.zip_with(F.slice("ids", F.lit(1), F.size("ids") - 1), F.slice("ids", F.lit(2), F.size("ids") - 1), lambda a, b: F.when((a >= 0) & (b >= 0), a * size + b))
        pairs = rows.where(F.size("ids") > 1).select("row", F.posexplode(key).alias("pos", "key")).where("key is not null")
        return _regrouped(pairs.join(names.select("key", "id"), "key").select("row", F.col("pos").cast("long").alias("pos"), "id"))
    known = np.array([tuple(r) for r in names.select("key", "id").orderBy("key").toLocalIterator()], np.int64).reshape(-1, 2)
    shared = arrays.sparkSession.sparkContext.broadcast((known[:, 0].copy(), known[:, 1].copy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ids = shared.value
        for batch in chain.from_iterable(map(_slices, batches)):
            flat, sizes = _flat(batch.column(0)), np.diff(batch.column(0).offsets.to_numpy())
            new = np.full(len(flat), BREAK)
            both = np.flatnonzero((flat[:-1] >= 0) & (flat[1:] >= 0))
            wanted = flat[both] * size + flat[both + 1]
            at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            hit = keys[at] == wanted
            new[both[hit]] = ids[at[hit]]
            yield from _batches([squeezed(a) for a in np.split(new, np.cumsum(sizes + 1)[:-1])])

    return arrays.mapInArrow(run, "ids array<long>")


def _wide(x: Column | str) -> Column:
    """Exact where products pass 64 bits."""
    return (F.col(x) if isinstance(x, str) else x).cast("decimal(28,0)")


def phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST, most: int = NAMES) -> tuple[DataFrame, DataFrame]:
    """Candidates (lang, phrase, k, a, l, r, held) and the number of words (lang, n).

    ``l`` and ``r`` are the counts at the cut that scores lowest, ``held`` the most occurrences of a
    longer phrase around it (0 for none).
    """
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kept = stored(word_counts(texts).where((F.col("f") >= least) | (F.col("phrase") == "")), "words")
    totals = kept.where("phrase = ''").select("lang", F.col("f").alias("n"))
    words, size = numbered(kept.where("phrase <> ''"), "vocabulary")
    level = words.select("id", "lang", "phrase", F.col("phrase").alias("last"), "f", F.array("f").alias("heads"), F.array("f").alias("tails"))
    arrays, levels = None, []
    for k in range(2, longest + 1):
        if not size:
            break
        arrays = stored(encoded(texts, level, size, most) if arrays is None else renamed(arrays, names, before, size, 4 * most), f"ids-{k}")
        names, count = numbered(pair_counts(arrays, size, least), f"pairs-{k}")
        named = names.select("id", "key", "f", F.expr(f"key div {size}").alias("a"), F.expr(f"key % {size}").alias("b"))
        head = level.select(F.col("id").alias("a"), "lang", F.col("phrase").alias("front"), "heads")
        tail = level.select(F.col("id").alias("b"), "last", "tails")
        joined = named.join(tail, "b").join(head, "a")
        new = stored(joined.select(
            "id", "lang", F.concat_ws(" ", "front", "last").alias("phrase"), "last", "f",
            F.concat("heads", F.array("f")).alias("heads"), F.concat("tails", F.array("f")).alias("tails"), "a", "b",
        ), f"level-{k}")
        parents = new.select(F.col("a").alias("id"), "f").unionByName(new.select(F.col("b").alias("id"), "f"))
        if levels:
            levels[-1] = levels[-1].drop("held").join(parents.groupBy("id").agg(F.max("f").alias("held")), "id", "left").na.fill(0, ["held"])
        levels.append(new.drop("a", "b").withColumns({"k": F.lit(k), "held": F.lit(0).cast("long")}))
        level, before, size = new.drop("a", "b"), size, count
    if not levels:
        return docs.sparkSession.createDataFrame([], "lang string, phrase string, k int, a long, l long, r long, held long, score long"), totals
    every = levels[0]
    for more in levels[1:]:
        every = every.unionByName(more)
    cut = every.withColumnRenamed("f", "a").withColumn("cut", best_cut(longest))
    return cut.select("lang", "phrase", "k", "a", "cut.l", "cut.r", "held", "cut.score"), totals


def best_cut(longest: int) -> Column:
    """(score, cut, l, r) of the lowest score, at the earliest cut of equals."""
    cuts = []
    for j in range(1, longest):
        left, right = F.get("heads", F.lit(j - 1)), F.get("tails", F.col("k") - j - 1)
        score = F.expr(f"(cast(a as decimal(28,0)) * {SCALE}) div (cast(get(heads, {j - 1}) as decimal(28,0)) + cast(get(tails, k - {j + 1}) as decimal(28,0)))")
        cuts.append(F.when(F.col("k") > j, F.struct(score.alias("score"), F.lit(j).alias("cut"), left.alias("l"), right.alias("r"))))
    return F.least(*cuts) if len(cuts) > 1 else cuts[0]


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST, top: int = TOP, most: int = NAMES) -> DataFrame:
    """Each language's first ``top`` phrases: lang, rank, phrase, a, l, r, n, score."""
    found, totals = phrases(docs, text_col, lang_col, least, longest, most)
    kept = found.where(100 * _wide("held") < HELD_PERCENT * _wide("a"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
