"""SimHash near-dedup: segment popcounts as grid coordinates, a range join, and an exact check.

Each 64-bit fingerprint is mapped to 32 segments of two bits; a segment's coordinate is its number
of set bits. The Manhattan distance of two such points is a lower bound of the Hamming distance, so
fingerprints that differ in at most ``bits`` bits lie within ``bits`` of each other, and in one half
of the segments within ``bits // 2``. The range join is a grid join: each point enters, for either
half, every grid point within ``bits // 4`` (rounded up) of its own; two points within ``bits // 2``
share one of these. Points that meet are verified on all 64 bits.

Only distinct fingerprints are joined; the documents of a fingerprint are one node. Where a grid
point holds many fingerprints, it is cut further by exact 13-bit blocks, of which a pair within four
bits shares one, and a task writes a spanning forest of the links it finds, not all pairs.

Defined cases: a null or wordless text has fingerprint zero and is linked like any other. Null ids
are fingerprinted; a component's id is its smallest non-null doc_id, null if there is none. Repeated
rows get the same result; ``drop_near_duplicates`` keeps one row of each component. Whole texts are
hashed, whatever their length. An empty table gives an empty result. Columns other than the id and
the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daylark.llm.common import small_side, stored, without
from daylark.llm.components import connected_components

SHINGLE_WORDS, LINK_BITS, SEED = 4, 4, 42
SEGMENTS_PER_HALF, SEGMENT_BITS = 16, 2
#: Fingerprints at one grid point that are compared all with all; larger grid points are cut by blocks first.
DENSE = 256
#: Rows of a fingerprint from which its component is looked up by broadcast.
HOT = 1_000
_BLOCKS = [(np.uint64(at), np.uint64((1 << size) - 1)) for at, size in ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))]


def hashes(raw: bytes, width: int = SHINGLE_WORDS) -> np.ndarray:
    """XXH64 of each shingle of ``width`` words of a lower-cased text, repeats included."""
    words = raw.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    cut = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], SEED) for a, b in cut], np.uint64)


def fingerprint(text: str | None) -> int:
    """Signed 64-bit fingerprint: a bit is set if over half of the shingle hashes have it."""
    found = hashes((text or "").encode("utf-8", "surrogatepass"))
    if not len(found):
        return 0
    votes = np.zeros(64, np.int64)
    for at in range(0, len(found), 32_768):
        part = found[at : at + 32_768].astype("<u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * votes > len(found), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) of each row."""
    wanted = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([fingerprint(t.as_py()) for t in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), made], names=["id", "fp"])

    return wanted.mapInArrow(run, f"id {wanted.schema['id'].dataType.simpleString()}, fp long")


def coordinates(fps: np.ndarray) -> np.ndarray:
    """(n, 32) popcounts of the two-bit segments, the lowest bits first."""
    ones = fps - ((fps >> np.uint64(1)) & np.uint64(0x5555555555555555))
    shifts = np.arange(0, 64, SEGMENT_BITS, dtype=np.uint64)
    return ((ones[:, None] >> shifts) & np.uint64(3)).astype(np.int64)


def grid_points(fps: np.ndarray, reach: int = 1) -> np.ndarray:
    """(n, k) keys of the grid points within ``reach`` (0 or 1) of either half of each point."""
    at = coordinates(fps)
    weight = np.int64(1) << (3 * np.arange(SEGMENTS_PER_HALF, dtype=np.int64))
    keys = []
    for half in (0, 1):
        own = ((at[:, half * SEGMENTS_PER_HALF : (half + 1) * SEGMENTS_PER_HALF] + 1) * weight).sum(axis=1)
        own += np.int64(half) << np.int64(50)
        steps = np.concatenate([[0], weight, -weight]) if reach else np.zeros(1, np.int64)
        keys.append(own[:, None] + steps)
    return np.concatenate(keys, axis=1)


def _forest(fps: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Spanning edges of the links among ``fps`` (distinct): each new node looks at those not yet reached."""
    edges, rest = [], fps
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            node = queue.pop()
            near = np.bitwise_count(rest ^ node) <= bits
            if near.any():
                reached = rest[near].tolist()
                edges += [(int(node), x) for x in reached]
                queue += list(rest[near])
                rest = rest[~near]
    return edges


def links(keys: np.ndarray, fps: np.ndarray, bits: int) -> np.ndarray:
    """Links among fingerprints of equal key; ``keys`` are sorted. Small runs give all, large ones a spanning forest."""
    edge = np.flatnonzero(np.diff(keys)) + 1
    starts = np.concatenate([[0], edge])
    sizes = np.diff(np.concatenate([starts, [len(keys)]]))
    found = []
    small = np.repeat(sizes <= 8, sizes)
    for off in range(1, 8):
        if len(keys) <= off:
            break
        at = np.flatnonzero((keys[off:] == keys[:-off]) & small[:-off])
        if not len(at):
            break
        near = np.bitwise_count(fps[at] ^ fps[at + off]) <= bits
        found.append(np.stack([fps[at[near]], fps[at[near] + off]], axis=1))
    for start, size in zip(starts[sizes > 8].tolist(), sizes[sizes > 8].tolist()):
        run = np.unique(fps[start : start + size])
        groups = [run]
        if len(run) > DENSE:
            groups = []
            for shift, mask in _BLOCKS:
                block = (run >> shift) & mask
                order = np.argsort(block, kind="stable")
                groups += np.split(run[order], np.flatnonzero(np.diff(block[order])) + 1)
        for group in groups:
            if pairs := _forest(group, bits) if len(group) > 1 else []:
                found.append(np.array(pairs, np.uint64))
    return np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 2), np.uint64)


def linked_fingerprints(points: DataFrame, bits: int = LINK_BITS) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints ``fp`` within ``bits`` bits of each other."""
    if not 0 <= bits <= 4:
        raise ValueError("the grid holds for 0 to 4 bits")
    reach = int(bits >= 2)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(fps), 4096):
                part = fps[at : at + 4096]
                keys = grid_points(part, reach)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.ravel()), pa.array(np.repeat(part, keys.shape[1]).view(np.int64))], names=["key", "fp"]
                )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(keys, fps):
            pairs = links(keys, fps.view(np.uint64), bits).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])

        held: list[tuple[np.ndarray, np.ndarray]] = []  # the last key's rows so far
        for batch in batches:
            keys, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(keys):
                continue
            done = np.searchsorted(keys, keys[-1])
            if held and (done or keys[0] != held[0][0][-1]):
                held.append((keys[:done], fps[:done]))
                yield out(*map(np.concatenate, zip(*held)))
                held = []
            elif done:
                yield out(keys[:done], fps[:done])
            held.append((keys[done:], fps[done:]))
        if held:
            yield out(*map(np.concatenate, zip(*held)))

    placed = points.select("fp").mapInArrow(place, "key long, fp long")
    return placed.repartition("key").sortWithinPartitions("key").mapInArrow(meet, "a long, b long")


def components_of(prints: DataFrame, best: Column, bits: int) -> DataFrame:
    """(fp, first, n) of each distinct fingerprint of ``prints``: the least ``best`` in its component, its own rows."""
    points = stored(prints.groupBy("fp").agg(F.min(best).alias("least"), F.count(F.lit(1)).alias("n")), "points")
    roots = connected_components(linked_fingerprints(points, bits))
    placed = points.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    return placed.join(placed.groupBy("root").agg(F.min("least").alias("first")), "root").select("fp", "first", "n")


def with_first(prints: DataFrame, named: DataFrame) -> DataFrame:
    """``prints`` with ``first``; hot fingerprints by broadcast, as all their rows have one key."""
    hot, rest = small_side(named.where(F.col("n") >= HOT)), named.where(F.col("n") < HOT)
    return prints.join(hot.drop("n"), "fp").unionByName(prints.join(rest.drop("n"), "fp"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = LINK_BITS) -> DataFrame:
    """One row per input row: id, fp (signed), component_id (see the module's defined cases)."""
    prints = stored(fingerprints(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", "text"), "fingerprints")
    found = with_first(prints, components_of(prints, F.col("id"), bits))
    return found.select(F.col("id").alias(id_col), "fp", F.col("first").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = LINK_BITS) -> DataFrame:
    """One row of each component, with all its columns: that of the smallest id.

    Null ids come last; of a component's rows with equal ids that with the least text hash stays, and one of rows with equal texts.
    """
    mark = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    keyed = docs.select(F.struct(F.col(id_col).isNull().alias("null_id"), F.col(id_col).alias("id"), mark.alias("mark")).alias("id"), F.col(text_col).alias("text"))
    prints = stored(fingerprints(keyed, "id", "text"), "fingerprints")
    found = stored(with_first(prints, components_of(prints, F.col("id"), bits)).select("id.id", "id.mark", (F.col("id") == F.col("first")).alias("kept")), "verdicts")
    gone = stored(found.where("not kept").select("id", "mark").distinct(), "dropped")
    tied = stored(found.where("kept").groupBy("id", "mark").count().where("count > 1").select("id", "mark"), "tied")
    return without(docs, id_col, mark, gone, tied)
