"""Helpers that the corpus operators share."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The six ASCII white-space characters that end a word; ``bytes.split()`` cuts at exactly these.
SPACES = b" \t\n\x0b\x0c\r"
#: A side of a join is broadcast up to this many (id or id-like) rows, counted first; beyond it the join shuffles.
BROADCAST_ROWS = 2_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only a local master may leave it unset; it then gets a temporary folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='daylark-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the finished Spark outputs in a folder of any store that Spark knows; none if it doesn't exist."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [x.getPath() for x in store.listStatus(at)] if store.exists(at) else []
    return sorted(p.getName() for p in found if store.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


_MADE: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that nothing has used yet."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def made() -> int:
    """How many working tables this process holds; a mark for ``release``."""
    return len(_MADE)


def release(spark: SparkSession, since: int = 0, but: Sequence[str] = ()) -> None:
    """Delete the working tables made after the mark ``since``, ``but`` those; call it when their results have been written."""
    kept = [p for p in _MADE[since:] if p in but]
    for name in [p for p in _MADE[since:] if p not in but]:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    _MADE[since:] = kept


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts the lineage, survives lost executors."""
    return stored_at(df, new_path(df.sparkSession, name))


def stored_at(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def without(docs: DataFrame, id_col: str, mark: Column, gone: DataFrame, tied: DataFrame) -> DataFrame:
    """``docs`` without the rows whose id and mark are in ``gone``, and with one row of each in ``tied``.

    ``gone`` and ``tied`` are stored tables (id, mark) without repeats. Ids may be null or repeated; a mark
    says which text a row has, so that rows with equal id and mark differ in other columns at most.
    """
    def same(a: DataFrame, b: DataFrame) -> Column:
        return a["id"].eqNullSafe(b["id"]) & a["mark"].eqNullSafe(b["mark"])

    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), mark.alias("mark"))
    gone = small_side(gone)
    left = rows.join(gone, same(rows, gone), "left_anti")
    if tied.isEmpty():
        return left.select("row.*")
    tied = small_side(tied)
    one = left.join(tied, same(left, tied), "left_semi").groupBy("id", "mark").agg(F.first("row").alias("row"))
    return left.join(tied, same(left, tied), "left_anti").select("row").unionByName(one.select("row")).select("row.*")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_bucket(id_col: str | Column, modulus: int) -> Column:
    """``crc32(id as text) mod modulus``; a null id counts as empty text."""
    column = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % modulus


def ascii_lower(text: Column) -> Column:
    """Lower case for A-Z only, other letters as they are; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it counts at most ``limit`` rows, else as it is (the join then shuffles)."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def least_count(words: DataFrame, column: str, most: int) -> float:
    """A count that at most ``most`` rows reach, from a histogram of the counts' sizes; infinite if all sizes have more."""
    size = F.floor(F.log2(F.col(column).cast("double")) * 8).cast("int")
    histogram = words.where(F.col(column) > 0).groupBy(size.alias("size")).agg(F.count(F.lit(1)).alias("words")).collect()
    total, least = 0, math.inf
    for level, n in sorted(((r[0], r[1]) for r in histogram), reverse=True):
        if total + n > most:
            break
        total, least = total + n, 2 ** (level / 8) * (1 - 1e-9)
    return least
