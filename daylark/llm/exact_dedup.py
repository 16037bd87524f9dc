"""Exact dedup over a log-structured merge index of text digests, in DataFrame operations only.

Memtables are the input partitions: a batch of documents is flushed as level 0, a run sorted by digest per
partition. Compaction merges the runs of a level into one of the next, with one entry per digest: the
smallest identifier (or the largest, as ``keep`` says) and the number of rows. All levels have the same
schema (digest, id, n), so merged runs merge again, ``FAN`` at a time. Each merged run keeps a filter, a
bitmap over its digests of 64 MB at most; a new batch joins an earlier run only with those of its digests
that the run's filter may hold.

Digests that more than one row has are hits; the texts of the rows that pass the hits' filter are compared
byte by byte, grouped after partial aggregation so that a hot group leaves each task as one row. The few
digests of ``HOT`` rows or more are joined by broadcast, the others by a shuffle.

Defined cases: a null text counts as empty; empty texts are equal to each other. A null id never
becomes the representative unless all ids of the group are null. Rows that share both id and text
are one document: all get the same result and ``group_size`` counts each; ``drop_duplicates`` keeps
exactly one row of each group. Ids may be of any type that can be ordered. Extra columns of the input are ignored whatever their names. An empty table gives an
empty result and an empty run.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daylark.llm.common import ascii_lower, folders, new_path, small_side, stored, without

#: Bits in one bucket of the hit filter (Spark's bitmap functions fix it) and the largest number of buckets: 64 MB.
FILTER_BITS, MOST_BUCKETS = 32_768, 16_384
BITS_PER_HIT = 16
#: Merged runs of a level that are merged into the next level, and rows of a digest from which it is broadcast.
FAN, HOT = 8, 1_000


def sha256_bytes(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


class DigestIndex:
    """Sorted digest runs (digest, id, n) under ``path``: ``flush`` adds a batch as level 0, ``compact`` merges.

    The list of live runs is written anew after each change; ``DigestIndex(spark, path)`` opens the latest one.
    """

    def __init__(self, spark, path: str | None = None, keep: str = "largest", digest: Callable = sha256_bytes):
        if keep not in ("largest", "smallest"):
            raise ValueError("keep is 'largest' or 'smallest'")
        self.spark, self.keep, self.digest = spark, keep, digest
        self.path = path or new_path(spark, "digests")
        self.version, self.runs = 0, []
        listed = [int(x.removeprefix("runs-")) for x in folders(spark, self.path) if x.startswith("runs-")]
        if listed:
            self.version = max(listed)
            rows = spark.read.schema("level int, name string").json(f"{self.path}/runs-{self.version}").collect()
            self.runs = [(r.level, r.name) for r in rows]

    def _list(self, runs: list[tuple[int, str]]) -> None:
        self.version, self.runs = self.version + 1, runs
        each = F.array([F.struct(F.lit(level).alias("level"), F.lit(name).alias("name")) for level, name in runs])
        self.spark.range(1, numPartitions=1).select(F.inline(each)).write.json(f"{self.path}/runs-{self.version}")

    def read(self, level: int) -> DataFrame:
        """All entries of the runs of a level."""
        return self.spark.read.parquet(*[f"{self.path}/{name}" for at, name in self.runs if at == level])

    def first(self, column: str = "id") -> Column:
        """The identifier that stays, as an aggregate."""
        return F.min(column) if self.keep == "smallest" else F.max(column)

    def flush(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Write a batch as sorted runs, one per input partition, and return their entries: one per row."""
        name = f"level0-{self.version + 1}"
        rows = docs.select(self.digest(ascii_lower(F.col(text_col))).alias("digest"), F.col(id_col).alias("id"), F.lit(1).cast("long").alias("n"))
        rows.sortWithinPartitions("digest").write.parquet(f"{self.path}/{name}")
        self._list([*self.runs, (0, name)])
        return self.spark.read.schema(rows.schema).parquet(f"{self.path}/{name}")

    def compact(self, level: int = 0) -> DataFrame:
        """Merge the runs of ``level`` into one run of the next, write its filter, and return its entries."""
        merged = self.read(level).groupBy("digest").agg(self.first().alias("id"), F.sum("n").alias("n"))
        name = f"level{level + 1}-{self.version + 1}"
        merged.sortWithinPartitions("digest").write.parquet(f"{self.path}/{name}")
        out = self.spark.read.schema(merged.schema).parquet(f"{self.path}/{name}")
        bits, buckets = bit_filter(out, out.count())
        bits.withColumn("buckets", F.lit(buckets)).write.parquet(f"{self.path}/filter-{name}")
        self._list([x for x in self.runs if x[0] != level] + [(level + 1, name)])
        return out

    def merge_full_levels(self) -> None:
        """Merge every level (from 1 on) that has ``FAN`` runs or more."""
        level = 1
        while sum(at == level for at, _ in self.runs) >= FAN:
            self.compact(level)
            level += 1

    def earlier(self, batch: DataFrame, runs: list[tuple[int, str]]) -> DataFrame | None:
        """Entries of ``runs`` for digests of ``batch``; a run is joined with what passes its filter."""
        found = []
        for level, name in runs:
            bits = self.spark.read.parquet(f"{self.path}/filter-{name}")
            size = bits.select("buckets").first()
            if level > 0 and size is not None:
                likely = passes(batch.select("digest"), bits.drop("buckets"), size.buckets)
                found.append(self.spark.read.parquet(f"{self.path}/{name}").join(likely.select("digest"), "digest", "left_semi"))
        return reduce(DataFrame.unionByName, found).groupBy("digest").agg(self.first().alias("id"), F.sum("n").alias("n")) if found else None


def bit_filter(digests: DataFrame, n: int) -> tuple[DataFrame, int]:
    """A bitmap of the digests, 4 KB per bucket, at most 64 MB in all; and its number of buckets."""
    buckets = min(MOST_BUCKETS, n * BITS_PER_HIT // FILTER_BITS + 1)
    bit = F.pmod(F.xxhash64("digest"), F.lit(buckets * FILTER_BITS))
    maps = digests.select(
        F.floor(bit / FILTER_BITS).cast("int").alias("bucket"), F.pmod(bit, F.lit(FILTER_BITS)).alias("bit")
    )
    return maps.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")), buckets


def passes(docs: DataFrame, bitmaps: DataFrame, buckets: int) -> DataFrame:
    """The rows of ``docs`` whose ``digest`` the filter may hold."""
    bit = F.pmod(F.xxhash64("digest"), F.lit(buckets * FILTER_BITS))
    inside = F.pmod(bit, F.lit(FILTER_BITS)).cast("int")
    byte = F.conv(F.hex(F.expr("substring(bits, at + 1, 1)")), 16, 10).cast("int")
    probed = docs.withColumns({
        "bucket": F.floor(bit / FILTER_BITS).cast("int"),
        "at": F.floor(inside / 8).cast("int"),
        "within": F.pmod(inside, F.lit(8)),
    }).join(F.broadcast(bitmaps), "bucket")
    return probed.where(F.pmod(F.floor(byte / F.pow(F.lit(2.0), F.col("within"))), F.lit(2)) == 1)


def verify(docs: DataFrame, hits: DataFrame, index: DigestIndex, id_col: str, text_col: str) -> DataFrame:
    """Groups of byte-equal texts among the rows whose digest is a hit: (digest, bytes, id, n).

    Only rows that pass the filter keep their text; each task aggregates its copies before the shuffle.
    """
    bitmaps, buckets = bit_filter(hits, hits.count())
    text = ascii_lower(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("bytes")).withColumn("digest", index.digest(F.col("bytes")))
    return passes(rows, bitmaps, buckets).groupBy("digest", "bytes").agg(index.first().alias("id"), F.count(F.lit(1)).alias("n"))


def joined_groups(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """``rows`` left-joined with ``groups`` (digest, first, size): hot groups by broadcast, as all their rows have one key."""
    hot, rest = small_side(groups.where(F.col("size") >= HOT)), groups.where(F.col("size") < HOT)
    return rows.join(hot, "digest").unionByName(rows.join(hot, "digest", "left_anti").join(rest, "digest", "left"))


def exact_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "largest",
    digest: Callable = sha256_bytes,
    index: DigestIndex | None = None,
    before: DataFrame | None = None,
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, digest (see the module's defined cases).

    Rows are equal when their texts are the same bytes after lower-casing A-Z. With an ``index`` that holds
    earlier batches, groups reach over all of them: ``before`` has the earlier rows, whose texts are
    compared too (their own results may change; run over ``before`` and ``docs`` with a new index for these).
    """
    index = index or DigestIndex(docs.sparkSession, keep=keep, digest=digest)
    older = [run for run in index.runs if run[0] > 0]
    if older and before is None:
        raise ValueError("the index holds earlier batches: give their rows as before")
    runs = index.flush(docs, id_col, text_col)
    batch = index.compact()
    known = index.earlier(batch, older)
    if known is not None:
        batch = batch.unionByName(known).groupBy("digest").agg(index.first().alias("id"), F.sum("n").alias("n"))
        batch = stored(batch, "batch-digests")
    index.merge_full_levels()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if older:
        rows = rows.unionByName(before.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    groups = stored(verify(rows, batch.where("n > 1").select("digest"), index, "id", "text"), "verified")
    variants = groups.groupBy("digest").agg(
        F.count(F.lit(1)).alias("variants"), index.first().alias("first"), F.sum("n").alias("size")
    )
    clean = variants.where("variants = 1 and size > 1").select("digest", "first", "size")
    colliding = variants.where("variants > 1").select("digest")
    if colliding.isEmpty():
        found = joined_groups(runs, clean)
    else:  # different texts under one digest: those rows are joined on the text itself
        odd = (
            docs.select(F.col(id_col).alias("id"), ascii_lower(F.col(text_col)).alias("bytes"))
            .withColumn("digest", index.digest(F.col("bytes")))
            .join(small_side(colliding), "digest", "left_semi")
            .join(groups.select("digest", "bytes", F.col("id").alias("first"), F.col("n").alias("size")), ["digest", "bytes"])
        )
        found = joined_groups(runs.join(small_side(colliding), "digest", "left_anti").drop("n"), clean).unionByName(odd.drop("bytes"))
    first = F.when(F.col("size").isNull(), F.col("id")).otherwise(F.col("first"))
    return found.select(
        F.col("id").alias(id_col),
        first.alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        F.col("id").eqNullSafe(first).alias("kept"),
        "digest",
    )


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """One row of each group of equal texts, with all its columns: that of the ``keep`` id.

    Null ids come last; of rows that share both id and text the first read stays.
    """
    if keep not in ("largest", "smallest"):
        raise ValueError("keep is 'largest' or 'smallest'")
    found = stored(exact_duplicates(docs, id_col, text_col, keep).select(F.col(id_col).alias("id"), F.col("digest").alias("mark"), "kept"), "verdicts")
    gone = stored(found.where("not kept").select("id", "mark").distinct(), "dropped")
    tied = stored(found.where("kept").groupBy("id", "mark").count().where("count > 1").select("id", "mark"), "tied")
    return without(docs, id_col, sha256_bytes(ascii_lower(F.col(text_col))), gone, tied)
