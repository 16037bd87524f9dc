"""SentencePiece encoding and decoding through one table of the corpus's distinct chunks.

The model's pieces never hold a white-space marker after another character (checked when the model
is loaded), so no merge crosses from a word into the next marker. A text is cut there: a chunk is a
run of markers and the characters up to the next marker. Each distinct chunk of the corpus is
segmented once. Frequent ones (``HEAD_CHUNKS`` of ``HEAD_BYTES`` bytes at most) are segmented first
and broadcast. A text leaves a hole where another chunk stands; the holes' (row, places, chunk) are
sorted by chunk, each run of equal chunks is segmented once, and the ids go back to the rows, by
place. Which chunks are frequent decides only the way they take, never an id. Texts are never shuffled:
what goes to the ids is each frequent chunk's rank (0 for a hole). Rows are packed on their way (``shares_of``).

Rows are numbered each of the two times that they are read, so they must come in the same order both
times, as the rows of files do; rows of any other origin are written first (``from_files=False``). A
text whose holes and ids don't match raises an error.

Defined cases: a null text counts as empty; an empty text has no ids and decodes to the empty
string. Null ids pass through; repeated rows are encoded each. The text is split without limits on
its length. An empty table gives an empty result. Columns other than the keys and the text are not
read. A chunk of more than ``HEAD_BYTES`` bytes isn't broadcast however often it occurs: its rows pass
through one task, as a stream.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daylark.llm.common import least_count, made, release, stored

MARK = "▁"
#: Chunks that are broadcast at most, and bytes of such a chunk at most.
HEAD_CHUNKS, HEAD_BYTES = 200_000, 256
#: Distinct chunks that a counting task holds before it passes on those met again.
HELD_CHUNKS = 400_000
#: Shares that rows are dealt to when packed, and bytes of rows that a task holds before it packs them.
SHARES, HELD_BYTES = 256, 16 << 20
HOLES = "number long, chunk string, places binary"
Make = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
_CHUNK = re.compile(f"{MARK}+[^{MARK}]*")


class Segmenter:
    """A model that segments chunks, each given without its first marker."""

    def __init__(self, model: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size())]
        crossing = [p for p in pieces if MARK in p.lstrip(MARK)]
        if crossing:
            raise ValueError(f"pieces cross white-space markers, so chunks can't be segmented alone: {crossing[:3]}")
        self.lone = self.model.piece_to_id(MARK)
        if [self.lone, *self.model.encode("a")] != self.model.encode(" a"):
            raise ValueError("the model doesn't put one marker before a text, or it drops spaces")
        #: How ids are kept; the largest value marks a hole.
        self.kind = np.dtype("<u2" if len(pieces) < 0xFFFF else "<u4")
        self.hole = np.array([np.iinfo(self.kind).max], self.kind).tobytes()
        self.names = [str(k) for k in range(len(pieces))]

    def segment(self, chunks: list[str]) -> list[bytes]:
        found = self.model.encode(chunks, num_threads=1)
        return [np.array(ids if c else [self.lone], self.kind).tobytes() for c, ids in zip(chunks, found)]


@lru_cache(maxsize=2)
def segmenter(model: str) -> Segmenter:
    return Segmenter(model)


def chunks(text: str) -> list[str]:
    """The chunks of a text, each without its first marker (the first one has the model's own marker)."""
    if MARK not in text and "  " not in text and text[:1] != " " and text[-1:] != " ":
        return text.split(" ") if text else []
    return [c[1:] for c in _CHUNK.findall(MARK + text.replace(" ", MARK))]


def frequent(docs: DataFrame, model: str, text_col: str = "text") -> dict[str, bytes]:
    """The chunks met most often, with their ids, by falling counts. A chunk that no task meets twice isn't frequent."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def drain() -> pa.RecordBatch:
            own = [(c, n) for c, n in found.items() if n > 1 and len(c.encode()) <= HEAD_BYTES]
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array([c for c, _ in own], pa.string()), pa.array([n for _, n in own], pa.int64())], names=["chunk", "n"])

        for batch in batches:
            for text in batch.column(0):
                found.update(chunks(text.as_py() or ""))
                if len(found) > HELD_CHUNKS:
                    yield drain()
        yield drain()

    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = segmenter(model)
        for batch in batches:
            ids = pa.array(known.segment(batch.column(0).to_pylist()), pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], names=["chunk", "n", "ids"])

    spark, start = docs.sparkSession, made()
    counts = docs.select(text_col).mapInArrow(count, "chunk string, n long").groupBy("chunk").agg(F.sum("n").alias("n"))
    counts = stored(counts, "chunk-counts")
    head = counts.where(F.col("n") >= least_count(counts, "n", HEAD_CHUNKS)).mapInArrow(segment, "chunk string, n long, ids binary").toArrow()
    release(spark, start)
    head = head.sort_by([("n", "descending"), ("chunk", "ascending")]).select(["chunk", "ids"])
    return dict(zip(head.column(0).to_pylist(), head.column(1).to_pylist()))


def packed(rows: pa.Table, share: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """The rows of each share as a compressed Arrow stream."""
    order = np.argsort(share, kind="stable")
    shares, first = np.unique(share[order], return_index=True)
    ordered = rows.take(pa.array(order))
    options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))
    for own, start, end in zip(shares.tolist(), first, [*first[1:], len(order)]):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema, options=options) as out:
            out.write_table(ordered.slice(start, end - start).combine_chunks())
        yield own, sink.getvalue().to_pybytes()


def shares_of(rows: DataFrame, make: Make, share: Callable[[pa.RecordBatch], np.ndarray]) -> DataFrame:
    """(share, data): what ``make`` gives of the batches of ``rows``, packed for their way to the task of their share.

    Small values of many rows compress by columns to half of what they take row by row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def drain() -> pa.RecordBatch:
            own = np.concatenate([share(b) for b in held]) % SHARES
            shares, data = zip(*packed(pa.Table.from_batches(held), own))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(shares, pa.int64()), pa.array(data, pa.binary())], names=["share", "data"])

        for batch in make(batches):
            if len(batch):
                held.append(batch)
            if sum(b.nbytes for b in held) >= HELD_BYTES:
                yield drain()
        if held:
            yield drain()

    return rows.mapInArrow(run, "share long, data binary")


def dealt(shares: DataFrame, kinds: str, *order: str | Column) -> DataFrame:
    """The rows in ``shares``, a share in one task, sorted by ``order`` in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(1):
                yield from pa.ipc.open_stream(data.as_buffer())

    return shares.repartition("share").mapInArrow(run, kinds).sortWithinPartitions(*order)


def segmenting(model: str) -> Make:
    """(number, chunk, places), equal chunks one after the other, with the ids; ``fresh`` marks the row at which a chunk was segmented."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, last, ids = segmenter(model), None, b""
        for batch in batches:
            names = batch.column(1).to_pylist()
            fresh = [c != before for c, before in zip(names, [last, *names])]
            new = iter(own.segment([c for c, f in zip(names, fresh) if f]))
            column = [ids := next(new) if f else ids for f in fresh]
            last = names[-1] if names else last
            columns = [*batch.columns, pa.array(column, pa.binary()), pa.array(fresh, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=["number", "chunk", "places", "ids", "fresh"])

    return run


def segmented(holes: DataFrame, model: str) -> DataFrame:
    """``holes`` with the ids of their chunks, each distinct chunk segmented once."""
    return holes.mapInArrow(segmenting(model), f"{HOLES}, ids binary, fresh boolean")


def texts_of(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Parts of the batches of about 4,000,000 characters or one row, with their texts."""
    for batch in batches:
        start, texts, size = 0, [], 0
        for text in batch.column(column):
            texts.append(text.as_py() or "")
            size += len(texts[-1])
            if size >= 4_000_000:
                yield batch.slice(start, len(texts)), texts
                start, texts, size = start + len(texts), [], 0
        if texts:
            yield batch.slice(start, len(texts)), texts


def filled(known: np.ndarray, hole: int, fixes: list[dict] | None) -> np.ndarray:
    """The ids of a text: ``known`` with the ids of the other chunks put where the holes are, by their places."""
    at = np.flatnonzero(known == hole)
    if not len(at) and not fixes:
        return known
    by_place: dict[int, np.ndarray] = {}
    for fix in fixes or ():
        ids = np.frombuffer(fix["ids"], known.dtype)
        by_place.update(dict.fromkeys(np.frombuffer(fix["places"], "<u4").tolist(), ids))
    parts, start = [], 0
    for end, place in zip(at.tolist(), sorted(by_place), strict=True):
        parts += [known[start:end], by_place[place]]
        start = end + 1
    return np.concatenate([*parts, known[start:]])


def holes_of(rows: DataFrame, common) -> DataFrame:
    """(number, chunk, places) over (number, text): where each chunk that isn't broadcast stands in each text.

    All rows of a chunk are in one task, one after the other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = common.value
        for part, texts in texts_of(batches, 1):
            out: tuple[list, ...] = ([], [], [])
            for number, text in zip(part.column(0).to_pylist(), texts):
                places: dict[str, list[int]] = {}
                for k, c in enumerate(chunks(text)):
                    if c not in head:
                        places.setdefault(c, []).append(k)
                out[0].extend([number] * len(places))
                out[1].extend(places)
                out[2].extend(np.array(p, "<u4").tobytes() for p in places.values())
            made = [pa.array(c, kind) for c, kind in zip(out, (pa.int64(), pa.string(), pa.binary()))]
            del out
            yield pa.RecordBatch.from_arrays(made, names=["number", "chunk", "places"])

    def share(batch: pa.RecordBatch) -> np.ndarray:
        return np.array([crc32(c.encode()) for c in batch.column(1).to_pylist()], np.int64)

    return dealt(shares_of(rows.select("number", "text"), run, share), HOLES, "chunk")


def encode_texts(
    docs: DataFrame, keys: list[str], model: str, text_col: str = "text", with_ids: bool = False, from_files: bool = False
) -> DataFrame:
    """``keys`` with the number of ids, digests of ids and decoded text, and the ids themselves if asked for.

    ``from_files`` says that ``docs`` are rows of files with no shuffle after the scan, so that they aren't written first.
    """
    rows = docs.select(F.struct(*keys).alias("keys"), F.col(text_col).alias("text"))
    rows = (rows if from_files else stored(rows, "texts")).select("keys", F.monotonically_increasing_id().alias("number"), "text")
    common = docs.sparkSession.sparkContext.broadcast(frequent(rows, model))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The ranks of each text's chunks from 1 on, 0 for each chunk that isn't broadcast, in three planes of bytes."""
        ranks = {c: k for k, c in enumerate(common.value, 1)}
        for part, texts in texts_of(batches, 2):
            planes: tuple[list, ...] = ([], [], [])
            for text in texts:
                own = np.array([ranks.get(c, 0) for c in chunks(text)], "<u4").view(np.uint8).reshape(-1, 4)
                for k, plane in enumerate(planes):
                    plane.append(own[:, k].tobytes())
            none = pa.nulls(len(part), pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *[pa.array(p, pa.binary()) for p in planes], none, none], names=columns)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The ids of the holes, in the columns that the texts' ranks have."""
        for batch in segmenting(model)(batches):
            none = pa.nulls(len(batch), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.nulls(len(batch), key_kind), batch.column(0), none, none, none, batch.column(2), batch.column(3)], names=columns)

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts in the order of their numbers, each followed by the ids of its holes."""
        own = segmenter(model)
        head, hole = [own.hole, *common.value.values()], int(np.iinfo(own.kind).max)
        kinds = [pa.int64(), pa.string(), pa.string(), *[pa.list_(pa.int32())] * with_ids]

        def encoded(planes: tuple[bytes, ...], fixes: list[dict]) -> tuple:
            ranks = np.zeros((len(planes[0]), 4), np.uint8)
            for k, plane in enumerate(planes):
                ranks[:, k] = np.frombuffer(plane, np.uint8)
            known = b"".join(map(head.__getitem__, ranks.view("<u4").ravel().tolist()))
            ids = filled(np.frombuffer(known, own.kind), hole, fixes).tolist()
            text = own.model.decode(ids) if ids else ""
            joined = ",".join(map(own.names.__getitem__, ids))
            return len(ids), sha256(joined.encode()).hexdigest(), sha256(text.encode()).hexdigest(), *[ids] * with_ids

        def result(keys: list[pa.Array], made: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.concat_arrays(keys), *[pa.array(list(c), kind) for c, kind in zip(zip(*made), kinds)]], names=["keys", *names])

        number, key, planes, fixes = None, None, None, []  # the text that may go on in the next batch
        for batch in batches:
            numbers = batch.column(1).to_pylist()
            starts = np.flatnonzero(batch.column(2).is_valid().to_numpy(zero_copy_only=False)).tolist()
            places, ids = (batch.column(k).to_pylist() for k in (5, 6))
            keys, made = [], []
            for start, end in zip([-1, *starts], [*starts, len(batch)]):
                if start >= 0:
                    if planes is not None:
                        keys.append(key)
                        made.append(encoded(planes, fixes))
                        if len(made) == 500:
                            yield result(keys, made)
                            keys, made = [], []
                    number, key, planes, fixes = numbers[start], batch.column(0).slice(start, 1), tuple(batch.column(k)[start].as_py() for k in (2, 3, 4)), []
                if any(n != number for n in numbers[max(start, 0) : end]):
                    raise ValueError("ids for a row that wasn't read again: rows must come in the same order both times")
                fixes += [{"places": p, "ids": i} for p, i in zip(places[start + 1 : end], ids[start + 1 : end])]
            if made:
                yield result(keys, made)
        if planes is not None:
            yield result([key], [encoded(planes, fixes)])

    def share(batch: pa.RecordBatch) -> np.ndarray:
        numbers = batch.column(1).to_numpy()
        return numbers + (numbers >> 33)  # a row's place in its partition, and the partition

    names = ["n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]
    columns = ["keys", "number", "low", "mid", "high", "places", "ids"]
    kind, key_kind = rows.schema["keys"].dataType.simpleString(), rows.select("keys").limit(0).toArrow().schema.field(0).type
    both = shares_of(rows, look_up, share).unionAll(shares_of(holes_of(rows, common), found, share))
    kinds = f"keys {kind}, number long, low binary, mid binary, high binary, places binary, ids binary"
    made = ", ".join(f"{n} {k}" for n, k in zip(names, ("long", "string", "string", "array<int>")))
    texts = dealt(both, kinds, "number", F.col("low").isNull())
    return texts.mapInArrow(assemble, f"keys {kind}, {made}").select("keys.*", *names)
