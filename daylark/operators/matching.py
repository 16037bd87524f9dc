"""Nearest-in-time and nearest-neighbour joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def nearest_within(left: DataFrame, right: DataFrame, owner: str, left_time: str, right_time: str, days: int = 60) -> DataFrame:
    """The right row of the same owner nearest in time to each left row, within ``days`` either way.

    Time is cut into buckets of ``days``; each right row enters its own bucket and both neighbours,
    so the join is on (owner, bucket) and a busy owner spreads over buckets. On ties the later right
    row wins, then the smaller right id. Left rows have ``left_id``, right rows ``right_id``.
    """
    span = days * 86_400
    seconds = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    l = left.withColumns({"__at": F.unix_micros(F.col(left_time).cast("timestamp")), "__bucket": F.floor(seconds(left_time) / span)})
    r = right.withColumn("__when", F.unix_micros(F.col(right_time).cast("timestamp")))
    r = r.withColumn("__bucket", F.explode(F.array(*[F.floor(seconds(right_time) / span) + k for k in (-1, 0, 1)])))
    pairs = l.join(r, [owner, "__bucket"])
    gap = F.abs(F.col("__at") - F.col("__when"))
    pairs = pairs.withColumn("gap_us", gap).where(F.col("gap_us") <= span * 1_000_000)
    # the aggregate takes the least (gap, -time, id) of each left row: two phases, no sort of a row's candidates
    best = F.min(F.struct("gap_us", (-F.col("__when")).alias("late"), "right_id")).alias("best")
    return pairs.groupBy("left_id").agg(best).select("left_id", "best.right_id", "best.gap_us")


def latest_per_owner(rows: DataFrame, owner: str, time: str, tie: str, most: int = 50) -> DataFrame:
    """The ``most`` latest rows of each owner, by time and then the smaller ``tie``."""
    window = Window.partitionBy(owner).orderBy(F.desc(time), tie)
    return rows.withColumn("__rank", F.row_number().over(window)).where(F.col("__rank") <= most).drop("__rank")


def merged(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both by key; where both have a key, the right one's values stand."""
    return left.join(right.select(*keys), keys, "left_anti").unionByName(right)


#: Bytes of query vectors that one broadcast block holds; queries and points that are compared at a time.
BLOCK_BYTES, QUERIES_AT_ONCE, POINTS_AT_ONCE = 64 << 20, 1000, 2000


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Vectors as rows of doubles; one that is missing, has gaps or isn't of ``width`` values is all NaN."""
    out = np.full((len(column), width), np.nan)
    whole = pc.fill_null(pc.equal(pc.list_value_length(column), width), False).to_numpy(zero_copy_only=False)
    if whole.any():
        out[whole] = column.filter(pa.array(whole)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, width)
    out[np.isnan(out).any(axis=1)] = np.nan
    return out


def _near(q: np.ndarray, q_ids: np.ndarray, p: np.ndarray, p_ids: np.ndarray, far: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, point, distance) of the pairs that may be among a query's ``k`` nearest, given the k-th distance ``far`` so far.

    A matrix product with a bound on its error finds them; their distances are then summed value by value.
    """
    q2, p2 = (q * q).sum(axis=1), (p * p).sum(axis=1)
    about = q2[:, None] + p2[None, :] - 2 * (q @ p.T)
    same = q_ids[:, None] == p_ids[None, :]
    about[same] = np.inf
    known = far * far
    fresh = np.flatnonzero(np.isinf(far))
    if len(fresh) and about.shape[1] > k:
        known[fresh] = np.partition(about[fresh], k - 1, axis=1)[:, k - 1]
    slack = 16 * (q.shape[1] + 8) * np.finfo(np.float64).eps * (q2 + np.nanmax(p2, initial=0.0))
    limit = known * (1 + 1e-12) + 2 * slack
    i, j = np.nonzero(~(about > limit[:, None]) & ~same)
    total = np.zeros(len(i))
    for c in range(q.shape[1]):
        apart = p[j, c] - q[i, c]
        total += apart * apart
    return i, j, np.sqrt(total)


def top_k(points: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` nearest points of each query by Euclidean distance, ties by point id.

    ``points`` and ``queries`` have (id, vector), ids are whole numbers. Queries are counted and cut into blocks of at most
    ``BLOCK_BYTES``, each broadcast against all points. A task passes on its own k nearest of a query, so what is shuffled grows
    with the queries alone. A vector that is missing or of another length has no distance and comes last.
    """
    spark = points.sparkSession
    size, width = queries.agg(F.sum(F.size("vector") * 8 + 64), F.max(F.size("vector"))).first()
    number = -(-(size or 0) // BLOCK_BYTES) or 1
    width = max(width or 0, 0)
    kinds = f"query_id {queries.schema['id'].dataType.simpleString()}, id {points.schema['id'].dataType.simpleString()}, distance double"
    near = Window.partitionBy("query_id").orderBy(F.col("distance").asc_nulls_last(), "id")
    rows = points.where("id is not null").select("id", "vector").coalesce(spark.sparkContext.defaultParallelism)
    own = queries.where("id is not null").select("id", "vector")
    out = None
    for block in range(number):
        found = own.where(F.pmod(F.xxhash64("id"), F.lit(number)) == block).toArrow()
        shared = spark.sparkContext.broadcast((found.column("id").to_numpy(), _matrix(found.column("vector").combine_chunks(), width)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, vectors = shared.value
            owners, others, gaps = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
            far = np.full(len(ids), np.inf)
            for batch in batches:
                for at in range(0, len(batch), POINTS_AT_ONCE):
                    part = batch.slice(at, POINTS_AT_ONCE)
                    p_ids, p = part.column(0).to_numpy(zero_copy_only=False), _matrix(part.column(1), width)
                    parts = [(owners, others, gaps)]
                    for start in range(0, len(ids), QUERIES_AT_ONCE):
                        end = start + QUERIES_AT_ONCE
                        i, j, gap = _near(vectors[start:end], ids[start:end], p, p_ids, far[start:end], k)
                        parts.append((i + start, p_ids[j], gap))
                    owners, others, gaps = map(np.concatenate, zip(*parts))
                    order = np.lexsort((others, gaps, owners))
                    owners, others, gaps = owners[order], others[order], gaps[order]
                    place = np.arange(len(owners)) - np.searchsorted(owners, owners)
                    far[owners[place == k - 1]] = np.nan_to_num(gaps[place == k - 1], nan=np.inf)
                    owners, others, gaps = (x[place < k] for x in (owners, others, gaps))
            distance = pa.array(gaps, pa.float64(), mask=np.isnan(gaps))
            yield pa.RecordBatch.from_arrays([pa.array(ids[owners]), pa.array(others), distance], names=["query_id", "id", "distance"])

        best = rows.mapInArrow(run, kinds).withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= k)
        out = best if out is None else out.unionByName(best)
    return out
