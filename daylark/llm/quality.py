"""Quality rules as a short-circuit cascade ordered by measured rejection per cost.

Every rule says whether it rejects a document. On a bounded sample each rule is timed and its
rejections are counted, on documents that the base rule lets pass and after the base counts have been
made, so that what is measured is what the cascade pays and gains; rules then run in descending
rejections per second, and a document stops at the first rule that rejects it. The verdict does not
depend on the order, only the cost does. Base counts are computed for every document.

Defined cases: a null text has no words, so its counts are 0 and the base rule rejects it; the same
holds for empty texts. Null ids pass through. Repeated rows are judged each. An empty table gives an
empty result (the rules then keep their written order). Other columns are not read.
"""

from __future__ import annotations

import string
import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import islice
from operator import eq
from unicodedata import category

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daylark.llm.common import SPACES

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
#: Documents that the order of the rules is estimated on; the bound is this many in expectation.
SAMPLE_DOCS = 2_000
_ASCII = bytes(range(128))
_UPPER = string.ascii_uppercase.encode()
_LETTERS = string.ascii_letters.encode()
_POWERS = np.array([pow(6364136223846793005, k, 1 << 64) for k in range(WINDOW)], dtype=np.uint64)


def count_of(text: bytes, chars: bytes) -> int:
    return len(text) - len(text.translate(None, chars))


def exact_repeats(words: list[bytes], window: int) -> int:
    seen = Counter(zip(*(islice(words, k, None) for k in range(window))))
    hit = np.zeros(len(words), bool)
    for k, own in enumerate(zip(*(islice(words, k, None) for k in range(window)))):
        if seen[own] > 1:
            hit[k : k + window] = True
    return int(hit.sum())


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside a window that the text holds twice or more, the first occurrence included."""
    n = len(words)
    if n <= window:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.uint64, n)
    if len(known) == n:
        return 0
    at = n - window + 1
    mix = np.zeros(at, np.uint64)
    for k in range(window):
        mix += ids[k : k + at] * _POWERS[k]
    order = np.argsort(mix, kind="stable")
    close = np.flatnonzero(mix[order[1:]] == mix[order[:-1]])
    if not len(close):
        return 0
    one, two = order[close], order[close + 1]
    same = np.ones(len(close), bool)
    for k in range(window):
        same &= ids[one + k] == ids[two + k]
    if not same.all():  # different windows with one hash may stand between equal ones
        return exact_repeats(words, window)
    edge = np.zeros(n + 1, np.int32)
    starts = np.unique(np.concatenate([one[same], two[same]]))
    edge[starts] += 1
    edge[starts + window] -= 1
    return int((np.cumsum(edge[:-1]) > 0).sum())


class Document:
    """A text with the quantities that rules need, each computed once and only when asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""

    def base(self) -> tuple[int, int, int, int, int, bool]:
        return self.n_words, self.word_chars, self.n_symbols, self.n_dup_lines, self.n_repeat_words, self.base_failed

    def again(self) -> Document:
        """A document that knows what this one knows so far."""
        other = Document(self.text)
        other.__dict__.update(self.__dict__)
        return other

    @cached_property
    def raw(self) -> bytes:
        return self.text.encode("utf-8", "surrogatepass")

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - count_of(self.raw, SPACES)

    @cached_property
    def n_symbols(self) -> int:
        return count_of(self.raw, SYMBOLS)

    @cached_property
    def beyond_ascii(self) -> str:
        return self.raw.translate(None, _ASCII).decode("utf-8", "surrogatepass")

    @cached_property
    def n_upper(self) -> int:
        # Roman numerals and circled letters are upper case too, but no letters
        return count_of(self.raw, _UPPER) + sum(category(c) == "Lu" for c in filter(str.isupper, self.beyond_ascii))

    @cached_property
    def n_letters(self) -> int:
        return count_of(self.raw, _LETTERS) + sum(map(str.isalpha, self.beyond_ascii))

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.raw.split(b"\n") if x.strip()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        return repeated_words(self.words)

    @cached_property
    def base_failed(self) -> bool:
        return self.n_words < 20 or 100 * self.n_repeat_words > 30 * self.n_words


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Document], bool]


def _symbols(d: Document) -> bool:
    return 10 * d.n_symbols > 3 * d.n_words


def _dup_lines(d: Document) -> bool:
    return 10 * (sum(map(len, d.lines)) - sum(map(len, set(d.lines)))) > 3 * len(d.raw)


def _shouting(d: Document) -> bool:
    return d.n_upper > 20 and 2 * d.n_upper > d.n_letters


def _exclaiming(d: Document) -> bool:
    return 10 * (d.raw.count(b"!") + d.raw.count(b"?")) > 3 * d.n_words


def _word_length(d: Document) -> bool:
    return not 2 * d.n_words <= d.word_chars <= 25 * d.n_words


def _letters(d: Document) -> bool:
    return 2 * d.n_letters < d.word_chars


def _stutter(d: Document) -> bool:
    words = d.words
    return 10 * sum(map(eq, words, islice(words, 1, None))) > 3 * d.n_words


def _one_word(d: Document) -> bool:
    return 10 * max(Counter(d.words).values(), default=0) > 3 * d.n_words


#: Written order; the cascade runs them by rejections per second.
RULES = (
    Rule("symbols", _symbols),
    Rule("duplicate_lines", _dup_lines),
    Rule("shouting", _shouting),
    Rule("exclaiming", _exclaiming),
    Rule("word_length", _word_length),
    Rule("letters", _letters),
    Rule("one_word", _one_word),
    Rule("stutter", _stutter),
)


def measure(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, sample: int = SAMPLE_DOCS) -> dict[str, tuple[int, int, float]]:
    """Per rule: sample rows that pass the base rule, rejections, seconds beyond the base counts. The sample is spread over the table, ``sample`` rows in expectation."""
    total = docs.count()
    if not total:
        return {}
    some = docs.select(text_col)
    if total > sample:
        some = some.sample(fraction=sample / total, seed=5)

    def clock(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, hits, spent = 0, [0] * len(rules), [0.0] * len(rules)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                known = Document(text)
                if known.base()[-1]:
                    continue
                seen += 1
                for k, rule in enumerate(rules):
                    d = known.again()
                    began = time.perf_counter()
                    hits[k] += bool(rule.rejects(d))
                    spent[k] += time.perf_counter() - began
        yield pa.RecordBatch.from_pydict({
            "rule": [r.name for r in rules], "seen": [seen] * len(rules), "hits": hits, "spent": spent
        })

    sums = (
        some.mapInArrow(clock, "rule string, seen long, hits long, spent double")
        .groupBy("rule")
        .agg(F.sum("seen"), F.sum("hits"), F.sum("spent"))
    )
    return {r[0]: (r[1], r[2], r[3]) for r in sums.collect()}


def ordered(rules: tuple[Rule, ...], measured: dict[str, tuple[int, int, float]]) -> tuple[Rule, ...]:
    """Rules by expected rejections per second, highest first; ties keep the written order."""
    def gain(rule: Rule) -> float:
        seen, hits, spent = measured.get(rule.name, (0, 0, 0.0))
        return -((hits + 0.5) / (seen + 1)) / max(spent / max(seen, 1), 1e-9)

    return tuple(sorted(rules, key=gain)) if measured else rules


COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"


def judge(docs: DataFrame, keys: list[str], text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``keys`` of each document with its base counts, ``base_failed`` and ``kept``."""
    cascade = ordered(rules, measure(docs, text_col, rules))
    wanted = docs.select(*keys, F.col(text_col).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keys).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(len(keys)):
                d = Document(text.as_py())
                base = d.base()
                rows.append((*base, not (base[-1] or any(rule.rejects(d) for rule in cascade))))
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2
            made = [pa.array(list(c), k) for c, k in zip(zip(*rows) if rows else [()] * 7, kinds)]
            names = [*keys, *(c.split()[0] for c in COLUMNS.split(", "))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *made], names=names)

    return wanted.mapInArrow(run, f"{schema}, {COLUMNS}")


def keep_good(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that no rule rejects, with all their columns, in one pass without a shuffle."""
    cascade = ordered(rules, measure(docs, text_col, rules))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for text in batch.column(at):
                d = Document(text.as_py())
                good.append(not d.base_failed and not any(rule.rejects(d) for rule in cascade))
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
