"""Language identification by spans: scripts narrow the candidates, Viterbi labels the words.

A word is cut where its script changes, and runs of over ``WINDOW`` letters (text without spaces) into
windows that share their border trigrams, so that every trigram counts once. Each piece has a score
per language: a smoothed log probability from the pieces of the training documents, or from its
character trigrams if it is not among the known ones. The script of a piece rules out languages that
the training documents don't write in it. Viterbi over a document's pieces, with a penalty for each
switch, labels spans; the language with the most letters is the document's.

The model is fitted on a sample of at most ``TRAIN_DOCS`` labelled documents in expectation, spread
over the table by a hash of the id. It holds at most ``KNOWN_WORDS`` pieces and ``KNOWN_GRAMS`` trigrams.

Defined cases: text that is null or has no letters is ``und`` with score 0 and no spans. Spans are
ranges of code points, end exclusive, from the first to the last letter of their pieces. Null ids
pass through; for the fold they count as the empty text. Repeated rows
are labelled each. Ties go to the language that sorts first. Without training rows all is ``und``.
An empty table gives an empty result. Columns other than those named are not read.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daylark.llm.common import crc_bucket
from daylark.llm.tokens import WordTable, counted

TRAIN_DOCS, KNOWN_WORDS, KNOWN_GRAMS = 20_000, 40_000, 150_000
SWITCH, FLOOR, RULED_OUT = 5.0, -7.0, -12.0
#: Letters in a window of a longer run.
WINDOW = 24
FOLDS, HELD_OUT = 4, 2
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_NO_LETTERS = re.compile(r"[^A-Za-z]+")
#: Words of Latin letters whose lower case is as long as they are.
_LATIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: Code-point ranges of the scripts, first to last.
SCRIPTS = {
    "Latin": ((0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF)),
    "Greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "Cyrillic": ((0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF)),
    "Armenian": ((0x530, 0x58F),),
    "Hebrew": ((0x590, 0x5FF),),
    "Arabic": ((0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF)),
    "Devanagari": ((0x900, 0x97F),),
    "Bengali": ((0x980, 0x9FF),),
    "Tamil": ((0xB80, 0xBFF),),
    "Thai": ((0xE00, 0xE7F),),
    "Georgian": ((0x10A0, 0x10FF),),
    "Hangul": ((0x1100, 0x11FF), (0xAC00, 0xD7AF)),
    "Kana": ((0x3040, 0x30FF),),
    "Han": ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x2FA1F)),
}


@lru_cache(maxsize=100_000)
def script_of(char: str) -> str | None:
    """The script whose ranges hold a letter or mark; "" for those that none holds, None for other characters."""
    if not char.isalpha() and unicodedata.category(char)[0] != "M":
        return None
    point = ord(char)
    return next((s for s, ranges in SCRIPTS.items() if any(a <= point <= b for a, b in ranges)), "")


def pieces(word: str) -> list[tuple[str, int, int]]:
    """(piece, start, end) of a word: its letters in lower case with the ends marked by ^ and $, and where they stand.

    Characters that are neither letters nor marks are passed over. A window that another one follows
    holds that one's first two letters too, so that each trigram is in one piece.
    """
    if word.isascii() and word.isalpha():
        runs = [(list(word.lower()), list(range(len(word))))]
    else:
        runs, last = [], None
        for k, char in enumerate(word):
            script = script_of(char)
            if script is None:
                continue
            if script == "" and not char.isalpha():
                script = last  # a mark goes with the letter before
            if not runs or script != last:
                runs.append(([], []))
            last = script
            for c in char.lower():
                runs[-1][0].append(c)
                runs[-1][1].append(k)
    out = []
    for chars, at in runs:
        n, text = len(chars), "".join(chars)
        if not any(map(str.isalpha, text)):
            continue
        for a in range(0, max(1, n - 2), WINDOW):
            end = n if a + WINDOW >= n - 2 else a + WINDOW
            body = text[a:] + "$" if end == n else text[a : end + 2]
            out.append(("^" + body if a == 0 else body, at[a], at[end - 1] + 1))
    return out


def pieces_of(word: bytes) -> list[str]:
    """The pieces of ``pieces`` alone; the letters of ASCII and other Latin words are one run."""
    text = word.decode("utf-8", "surrogatepass")
    if text.isascii():
        body = text.lower() if text.isalpha() else _NO_LETTERS.sub("", text).lower()
    elif _LATIN.fullmatch(text):
        body = text.lower()
    else:
        return [p for p, _, _ in pieces(text)]
    if len(body) <= WINDOW + 2:
        return [f"^{body}$"] if body else []
    return [p for p, _, _ in pieces(text)]


def letters(piece: str) -> int:
    """The letters that a piece alone has."""
    return len(piece) - piece.startswith("^") - (1 if piece.endswith("$") else 2)


def grams(piece: str) -> list[str]:
    return [piece[k : k + 3] for k in range(len(piece) - 2)]


@dataclass
class Model:
    languages: list[str]
    words: dict[str, np.ndarray]
    grams: dict[str, np.ndarray]
    unseen: np.ndarray
    scripts: dict[str, np.ndarray]  #: per script, whether each language is written in it

    def describe(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The words' pieces, one row each, and how many each word has.

        A row has the scores of the languages, 0 for the best and ``FLOOR`` at least, and the number of letters.
        """
        cut = [pieces_of(w) for w in words]
        texts = [p for own in cut for p in own]
        count = np.fromiter(map(len, cut), np.int64, len(cut))
        states = len(self.languages)
        out = np.zeros((len(texts), states + 1), np.float32)
        if not states or not texts:
            return out, count
        number, table = self._gram_rows()
        raw = np.zeros((len(texts), states))
        at, ids, sizes, scripts = [], [], [], {"Latin": []}
        out[:, states] = [letters(text) for text in texts]
        latin = scripts["Latin"]
        for k, text in enumerate(texts):
            first = text[text[0] == "^"]
            if first.isascii():
                latin.append(k)
            else:
                scripts.setdefault(script_of(first), []).append(k)
            known = self.words.get(text)
            if known is not None:
                raw[k] = known
            else:
                at.append(k)
                sizes.append(len(text) - 2)
                ids += [number.get(text[j : j + 3], -1) for j in range(len(text) - 2)]
        if at:
            starts = np.cumsum([0, *sizes[:-1]])
            raw[at] = np.add.reduceat(table[ids], starts, axis=0)
        score = np.maximum(raw - raw.max(axis=1, keepdims=True), FLOOR)
        for script, rows in scripts.items():
            allowed = self.scripts.get(script)
            if allowed is not None and allowed.any() and not allowed.all():
                narrowed = np.where(allowed, score[rows], RULED_OUT)
                score[rows] = narrowed - narrowed.max(axis=1, keepdims=True)
        out[:, :states] = score
        return out, count

    def _gram_rows(self) -> tuple[dict[str, int], np.ndarray]:
        """Row numbers of the trigrams and their scores; the last row is for others."""
        if not hasattr(self, "_rows"):
            self._rows = {g: k for k, g in enumerate(self.grams)}, np.array([*self.grams.values(), self.unseen])
        return self._rows


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most_docs: int = TRAIN_DOCS) -> Model:
    """Fit on labelled documents outside the held-out fold."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    rows = rows.where(F.col("lang").isNotNull() & (crc_bucket("id", FOLDS) != HELD_OUT))
    n = rows.select("id").count()
    if n > most_docs:
        rows = rows.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1_000_000)) < int(1_000_000 * most_docs / n))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def words(batch):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield lang, (text or "").encode("utf-8", "surrogatepass").split()

        for langs, found, ns in counted(batches, words):
            cut = [(lang, p, n) for lang, w, n in zip(langs, found, ns) for p in pieces_of(w)]
            columns = zip(*cut) if cut else ((), (), ())
            made = [pa.array(list(c), kind) for c, kind in zip(columns, (pa.string(), pa.string(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(made, names=["lang", "word", "n"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, str, str], int] = {}
        for batch in batches:
            for lang, word, n in zip(*(c.to_pylist() for c in batch.columns)):
                for g in grams(word):
                    sums[lang, "gram", g] = sums.get((lang, "gram", g), 0) + n
                key = (lang, "script", script_of(word[word[0] == "^"]) or "")
                sums[key] = sums.get(key, 0) + n
        langs, kinds, keys = zip(*sums) if sums else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(langs, pa.string()), pa.array(kinds, pa.string()), pa.array(keys, pa.string()), pa.array(list(sums.values()), pa.int64())],
            names=["lang", "kind", "key", "n"],
        )

    words = rows.select("lang", "text").mapInArrow(count, "lang string, word string, n long")
    words = words.groupBy("lang", "word").agg(F.sum("n").alias("n")).cache()
    totals = {r[0]: (r[1], r[2]) for r in words.groupBy("lang").agg(F.sum("n"), F.count(F.lit(1))).collect()}
    languages = sorted(totals)
    top = words.groupBy("word").agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by"))
    known = top.where("n > 1").orderBy(F.desc("n"), "word").limit(KNOWN_WORDS).select("word", "by").collect()
    parts = words.mapInArrow(cut, "lang string, kind string, key string, n long").groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))
    parts = parts.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by"))
    parts = parts.orderBy(F.desc("n"), "kind", "key").limit(KNOWN_GRAMS).select("kind", "key", "by").collect()
    words.unpersist()

    def logs(by: dict[str, int], total: np.ndarray, add: float) -> np.ndarray:
        return np.log((np.array([by.get(x, 0) for x in languages]) + add) / total)

    word_total = np.array([totals[x][0] + 0.1 * len(known) for x in languages])
    sums = np.array([sum(r["by"].get(x, 0) for r in parts if r["kind"] == "gram") for x in languages])
    gram_total = sums + 0.5 * max(1, len(parts))
    scripts = {r["key"]: np.array([50 * r["by"].get(x, 0) >= totals[x][0] for x in languages]) for r in parts if r["kind"] == "script" and r["key"]}
    return Model(
        languages,
        {r["word"]: logs(r["by"], word_total, 0.1) for r in known},
        {r["key"]: logs(r["by"], gram_total, 0.5) for r in parts if r["kind"] == "gram"},
        np.log(0.5 / gram_total) if languages else np.zeros(0),
        scripts,
    )


def viterbi(scores: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best states (positions, documents) for scores (positions, documents, states); padding scores 0."""
    steps, docs, states = scores.shape
    best = scores[0].copy()
    stays = np.ones((steps, docs, states), bool)
    leaders = np.zeros((steps, docs), np.int64)
    row = np.arange(docs)
    for t in range(1, steps):
        leader = best.argmax(axis=1)
        jump = (best[row, leader] - switch)[:, None]
        np.greater_equal(best, jump, out=stays[t])
        leaders[t] = leader
        np.maximum(best, jump, out=best)
        best += scores[t]
    path = np.zeros((steps, docs), np.int64)
    path[-1] = best.argmax(axis=1)
    for t in range(steps - 1, 0, -1):
        now = path[t]
        path[t - 1] = np.where(stays[t, row, now], now, leaders[t])
    return path


def label_words(rows: list[np.ndarray], data: np.ndarray, states: int, most: int = 400_000) -> list[np.ndarray]:
    """The state of each piece of each document; documents of like length go together."""
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(rows)
    order = sorted((k for k in range(len(rows)) if len(rows[k])), key=lambda k: len(rows[k]))
    at = 0
    while at < len(order):
        group = [order[at]]
        first = len(rows[order[at]])
        while at + len(group) < len(order):
            size = len(rows[order[at + len(group)]])
            if size > 2 * first + 16 or size * (len(group) + 1) > most:
                break
            group.append(order[at + len(group)])
        at += len(group)
        steps = len(rows[group[-1]])
        scores = np.zeros((steps, len(group), states), np.float32)
        for d, k in enumerate(group):
            scores[: len(rows[k]), d] = data[rows[k], :states]
        path = viterbi(scores)
        for d, k in enumerate(group):
            out[k] = path[: len(rows[k]), d]
    return out


def spans_of(text: str, states: np.ndarray, languages: list[str]) -> list[dict]:
    """Runs of equal states as code-point ranges; there is a state for each piece of the text."""
    at = [(m.start() + a, m.start() + b) for m in _WORD.finditer(text) for _, a, b in pieces(m[0])]
    edges = np.flatnonzero(np.diff(states)) + 1
    return [
        {"start": at[a][0], "end": at[b - 1][1], "lang": languages[states[a]]}
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(states)]) if b > a
    ]


def identify(docs: DataFrame, keys: list[str], model: Model, text_col: str = "text", with_spans: bool = False) -> DataFrame:
    """``keys`` with ``lang_pred``, ``score`` and, if asked for, ``spans``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    wanted = docs.select(*keys, F.col(text_col).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keys).schema)
    schema += ", lang_pred string, score double" + ", spans array<struct<start:int,end:int,lang:string>>" * with_spans
    names = [*keys, "lang_pred", "score", *["spans"] * with_spans]
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
    kinds = [pa.string(), pa.float64(), *[span] * with_spans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        states = len(own.languages)
        table = WordTable(own.describe, states + 1)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                texts = [t or "" for t in part.column(len(keys)).to_pylist()]
                rows = table.index([t.encode("utf-8", "surrogatepass").split() for t in texts])
                paths = label_words(rows, table.data, states) if states else [np.zeros(0, np.int64)] * len(rows)
                out = []
                for text, row, path in zip(texts, rows, paths):
                    size = table.data[row, states] if len(row) else np.zeros(0)
                    if not states or not size.sum():
                        out.append(("und", 0.0, *[[]] * with_spans))
                        continue
                    share = np.bincount(path, weights=size, minlength=states) / size.sum()
                    best = int(share.argmax())
                    total = table.data[row, :states].sum(axis=0, dtype=np.float64)
                    odds = np.exp(np.clip(total - total[best], -60, 60)).sum()
                    spans = [spans_of(text, path, own.languages)] if with_spans else []
                    out.append((own.languages[best], float(share[best] / odds), *spans))
                made = [pa.array(list(c), k) for c, k in zip(zip(*out), kinds)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keys)], *made], names=names)

    return wanted.mapInArrow(run, schema)
