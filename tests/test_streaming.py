"""Streams against their batch forms."""

from pyspark.sql import functions as F

from daylark.sources import versions
from daylark.streaming import daily


def test_daily_windows_equal_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = daily.daily_windows(stream.withColumn("ts", F.col("ts").cast("timestamp")), late="60 days").writeStream.outputMode("complete")
    query = query.format("memory").queryName("windows").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = spark.table("windows").count()
    want = events.select(F.to_date("ts"), "user_id", "event_type").distinct().count()
    assert got == want


def test_upsert_stream_keeps_last(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "k int, at int, v string")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    target = f"file://{tmp_path}/table"
    daily.upsert_stream(stream, target, ["k"], ["at"], str(tmp_path / "cp")).awaitTermination(120)
    assert sorted((r.k, r.v) for r in versions.read(spark, target).collect()) == [(1, "b"), (2, "c")]
