"""Per-task tables of distinct words, and word counts per partition.

Defined cases: no texts or texts without words give no rows; words of any length and repeated words are
taken as they are. A table is cleared by its number of words or their bytes, never in the middle of a batch.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa


class WordTable:
    """Rows of numbers per distinct word, computed once by ``describe`` and kept up to ``most`` words or ``most_bytes``.

    ``describe`` takes a list of words and gives an array (words, width), or an array of all their rows
    and the number of rows of each word, which may be none.
    """

    def __init__(self, describe: Callable[[list[bytes]], np.ndarray | tuple[np.ndarray, np.ndarray]], width: int, most: int = 250_000, most_bytes: int = 32 << 20):
        self.describe, self.width, self.most, self.most_bytes = describe, width, most, most_bytes
        self._clear()

    def _clear(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.first = np.zeros(4097, np.int64)
        self.data = np.zeros((4096, self.width), np.float32)
        self.bytes, self.alone = 0, True

    def _add(self, new: list[bytes]) -> None:
        start, end = len(self.numbers), len(self.numbers) + len(new)
        found = self.describe(new)
        rows, count = found if isinstance(found, tuple) else (found, np.ones(len(new), np.int64))
        self.alone = self.alone and bool((count == 1).all())
        if end + 1 > len(self.first):
            self.first = np.concatenate([self.first, np.zeros(max(len(self.first), end + 1 - len(self.first)), np.int64)])
        at = self.first[start]
        self.first[start + 1 : end + 1] = at + np.cumsum(count)
        last = self.first[end]
        if last > len(self.data):
            self.data = np.concatenate([self.data, np.zeros((max(len(self.data), last - len(self.data)), self.width), np.float32)])
        self.data[at:last] = rows
        self.numbers.update(zip(new, range(start, end)))
        self.bytes += sum(map(len, new))

    def index(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        """The row numbers of each text's words in order. A full table starts anew, which renumbers its rows."""
        if len(self.numbers) > self.most or self.bytes > self.most_bytes:
            self._clear()
        new = list(set(chain.from_iterable(texts)) - self.numbers.keys())
        if new:
            self._add(new)
        numbers = [np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words)) for words in texts]
        return numbers if self.alone else [self._rows(n) for n in numbers]

    def _rows(self, numbers: np.ndarray) -> np.ndarray:
        first = self.first[numbers]
        count = self.first[numbers + 1] - first
        return np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())


def counted(batches: Iterator[pa.RecordBatch], keys_of: Callable[[pa.RecordBatch], Iterator[tuple[str, Iterable[bytes]]]], most: int = 300_000) -> Iterator[tuple[list[str], list[bytes], list[int]]]:
    """Counts per (label, word) of a partition, given out whenever ``most`` of them have gathered."""
    tables: dict[str, Counter] = {}

    def drain():
        labels, words, ns = [], [], []
        for label, table in tables.items():
            labels += [label] * len(table)
            words += table.keys()
            ns += table.values()
        tables.clear()
        return labels, words, ns

    for batch in batches:
        for label, words in keys_of(batch):
            tables.setdefault(label, Counter()).update(words)
        if sum(map(len, tables.values())) > most:
            yield drain()
    if tables:
        yield drain()
