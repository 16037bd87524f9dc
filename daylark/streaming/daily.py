"""Incremental forms of ingest and daily aggregation with Structured Streaming."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from daylark.sources import versions
from daylark.sources.ingest import keep_last, upsert


def daily_windows(events: DataFrame, time: str = "ts", keys: Sequence[str] = ("user_id", "event_type"), value: str = "value", late: str = "2 days") -> DataFrame:
    """Daily count, mean and extremes per key; rows later than the watermark are dropped."""
    days = events.withWatermark(time, late).groupBy(F.window(time, "1 day").alias("day"), *keys)
    return days.agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high")).select(
        F.to_date("day.start").alias("date"), *keys, "n", "mean", "low", "high"
    )


def upsert_stream(events: DataFrame, path: str, keys: Sequence[str], order: Sequence[str], checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Keep the last row per key in a table of versions (``versions.read``); each batch is one version, a replayed one none.

    The table's parts are buckets by a hash of the keys: a batch reads and writes only the buckets it touches, and its
    version shares the others with the one before. The version's record names the batch, so that a batch whose commit came
    through just before a crash isn't merged again.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        now = versions.record(spark, path)
        if now and now["batches"].get(checkpoint, -1) >= number:
            return
        bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
        new = keep_last(batch, keys, [F.col(c) for c in order]).cache()
        touched = [str(r[0]) for r in new.select(bucket).distinct().collect()]
        if touched:
            old = versions.read(spark, path, now["number"], touched) if now else None
            merged = new if old is None else upsert(old, new, keys)
            rows = merged.withColumn("bucket", bucket).repartition("bucket")
            versions.commit(rows, path, now["number"] if now else None, "bucket", touched, {checkpoint: number})
        new.unpersist()

    return events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
