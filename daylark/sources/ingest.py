"""CSV ingest by declared schema: typed rows, rejects, upserts, audit; and other sinks."""

from __future__ import annotations

import csv
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from daylark.catalog import Field, Table, lookup
from daylark.functions.missing import ingest_value
from daylark.session import checkpointed
from daylark.sources import versions

MOST_ERRORS = 20


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, file, number) of the lines that aren't empty; the first of a file has number 0.

    A task numbers the lines of each block of a file as it reads them. The blocks' line counts, one row a
    block, give the number of lines before each; no line is shuffled.
    """
    text = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, count = None, 0
        for batch in batches:
            nth = []
            batch = batch.filter(pc.not_equal(batch.column(0), ""))
            for key in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                last, count = key, count + 1 if key == last else 0
                nth.append(count)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nth, pa.int64())], names=["line", "file", "block", "nth"])

    lines = text.mapInArrow(run, "line string, file string, block long, nth long")
    counts = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block")) - F.col("n")
    return lines.join(counts.select("file", "block", before.alias("before")), ["file", "block"]).select("line", "file", (F.col("before") + F.col("nth")).alias("number"))


def read_csv(spark: SparkSession, path: str, table: Table) -> DataFrame:
    """The files' declared columns as text, and each record's ``file`` and ``row``: its place, where the header is row 1.

    A record is a line; empty lines are passed over and not counted. Undeclared columns are dropped, absent ones and
    fields that a short record lacks are null. Without any record, a header that can't be read is an error.
    """
    lines = numbered_lines(spark, path)
    headers = [tuple(r) for r in lines.where("number = 0").select("line", "file").collect()]  # one for each file
    records = lines.where("number > 0")
    if not any("," in h or "\t" in h or ";" in h or "|" in h for h, _ in headers) or any(h.count('"') % 2 for h, _ in headers):
        if records.isEmpty():
            raise ValueError("CSV parse failed: " + ("the header can't be read" if headers else "the file is empty"))
    by_header: dict[str, list[str]] = {}
    for header, file in headers:
        by_header.setdefault(header, []).append(file)
    out = None
    for header, files in by_header.items():
        names = [c.strip() for c in next(csv.reader([header.removeprefix("\ufeff")]), [])]
        have = {c: k for k, c in enumerate(names)}
        if not set(have) & {f.header for f in table.fields}:
            raise ValueError(f"the file has no column of {table.key}")
        schema = StructType([StructField(f"c{k}", StringType()) for k in range(len(names))])
        own = records if len(by_header) == 1 else records.where(F.col("file").isin(files))
        parsed = own.select("file", (F.col("number") + 1).alias("row"), F.from_csv("line", schema.simpleString()[7:-1].replace(":", " "), {"escape": '"'}).alias("x"))
        one = parsed.select("file", "row", *[
            (F.col(f"x.c{have[f.header]}") if f.header in have else F.lit(None).cast("string")).alias(f.header) for f in table.fields
        ])
        out = one if out is None else out.unionByName(one)
    return out


def typed(raw: DataFrame, fields: Sequence[Field]) -> DataFrame:
    """Coerced and renamed columns, and ``reason``: which required column is missing, if any; ``file`` and ``row`` stay as ``__file`` and ``__row``."""
    values = {f.column: ingest_value(F.col(f"`{f.header}`"), f.kind) for f in fields}
    missing = F.lit(None).cast("string")
    for f in reversed([f for f in fields if f.required]):
        missing = F.when(values[f.column].isNull(), F.lit(f"missing {f.column}")).otherwise(missing)
    place = [F.col(c).alias(f"__{c}") for c in ("file", "row") if {"file", "row"} <= set(raw.columns)]
    return raw.select(*[v.alias(k) for k, v in values.items()], missing.alias("reason"), *place)


def accepted(rows: DataFrame) -> DataFrame:
    return rows.where("reason is null").drop("reason", "__file", "__row")


def rejected(rows: DataFrame) -> DataFrame:
    return rows.where("reason is not null")


def keep_last(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the last by ``order``, which has to be total."""
    window = Window.partitionBy(*keys).orderBy(*[c.desc() for c in order])
    return rows.withColumn("__rank", F.row_number().over(window)).where("__rank = 1").drop("__rank")


def upsert(current: DataFrame, batch: DataFrame, keys: Sequence[str], order: Sequence[Column] = ()) -> DataFrame:
    """``current`` with the rows of ``batch`` put in place of those with equal keys.

    Keys that occur more than once in the batch keep their last row by ``order``.
    """
    new = keep_last(batch, keys, order or [F.struct(*batch.columns)])
    return current.join(new.select(*keys), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def new_keys(batch: DataFrame, current: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct keys of ``batch`` that ``current`` doesn't have."""
    return batch.select(*keys).distinct().join(current.select(*keys), list(keys), "left_anti")


#: Bytes of a file that a preview reads.
PREVIEW_BYTES = 32 << 10


def head(spark: SparkSession, path: str, most: int = PREVIEW_BYTES) -> bytes:
    """The first ``most`` bytes of a file of any store that Spark knows; no more are read."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).open(at)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(spark._jvm.org.apache.commons.io.input.BoundedInputStream(stream, most)))
    finally:
        stream.close()


def preview(spark: SparkSession, path: str, table: Table, rows: int = 5) -> tuple[DataFrame, list[str], list[str]]:
    """First rows of a file from its first 32 KiB, its headers, and those that the table expects. A record that the limit cuts is left out."""
    raw = head(spark, path)
    text = raw.decode("utf-8-sig", "ignore")
    if len(raw) == PREVIEW_BYTES:
        text = text[: text.rfind("\n") + 1]
    records = [r for r in csv.reader(text.splitlines()) if r]
    headers = [c.strip() for c in records[0]] if records else []
    found = [tuple((r + [None] * len(headers))[: len(headers)]) for r in records[1 : rows + 1]]
    schema = StructType([StructField(h or f"_c{k}", StringType()) for k, h in enumerate(headers)])
    return spark.createDataFrame(found, schema), headers, [c for c in headers if c in {f.header for f in table.fields}]


def first_errors(rows: DataFrame, most: int = MOST_ERRORS) -> DataFrame:
    """(file, row, reason) of the first rejects."""
    return rejected(rows).select(F.col("__file").alias("file"), F.col("__row").alias("row"), "reason").orderBy("file", "row").limit(most)


def audit(table: Table, rows: DataFrame) -> DataFrame:
    """One audit row: inserted and skipped rows, the first twenty errors with their row, participants, span of days."""
    days = [F.min("day_in_study").alias("day_min"), F.max("day_in_study").alias("day_max")] if table.has_days else []
    good = F.col("reason").isNull()
    errors = first_errors(rows).agg(F.array_sort(F.collect_list(F.struct("file", "row", "reason"))).alias("errors"))
    counts = rows.agg(
        F.lit(table.key).alias("table_name"),
        F.count_if(good).alias("rows_inserted"),
        F.least(F.count_if(~good), F.lit(MOST_ERRORS)).alias("rows_skipped"),
        F.count_if(~good).alias("rows_rejected"),
        F.countDistinct(F.when(good, F.col("participant_id"))).alias("participants"),
        *days,
    )
    return counts.join(errors)  # one row each


def ingest(spark: SparkSession, key: str, path: str, store: str) -> DataFrame:
    """Load one CSV into the table under ``store``: add new participants, upsert its rows, append and return the audit row.

    The rows become the table's next version (``versions.read`` gives the latest); a run that stops
    anywhere may be repeated and leaves the same tables.
    """
    table = lookup(key)
    rows = checkpointed(typed(read_csv(spark, path, table), table.fields))
    target, people = f"{store}/{key}", f"{store}/participants"
    batch = accepted(rows)
    known = versions.read(spark, people)
    ids = batch.select("participant_id").distinct()
    new = ids if known is None else new_keys(ids, known, ["participant_id"])
    if known is None or not new.isEmpty():
        versions.replace(new if known is None else known.unionByName(new), people)
    place = [F.col("__file"), F.col("__row")]
    before = versions.numbers(spark, target)
    current = versions.read(spark, target, before[-1]) if before else None
    latest = keep_last(rows.where("reason is null"), table.merge_keys, place).drop("reason", "__file", "__row")
    after = latest if current is None else upsert(current, latest, table.merge_keys)
    versions.commit(after, target, before[-1] if before else None)
    entry = audit(table, rows)
    entry.write.mode("append").parquet(f"{store}/ingest_runs_{key}")
    return entry


def read_or_empty(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    files = spark._jvm.org.apache.hadoop.fs.Path(path)
    if files.getFileSystem(spark._jsc.hadoopConfiguration()).exists(files):
        return spark.read.schema(like.schema).parquet(path)
    return spark.createDataFrame([], like.schema)


def overwrite(rows: DataFrame, path: str) -> None:
    """Replace a parquet table by rows that may come from it: written beside, then moved into place.

    The old table is moved aside before and deleted after; the next call (or ``restore``) puts it back after a crash in
    between. A reader may meet no table meanwhile: tables with readers are kept in versions.
    """
    spark = rows.sparkSession
    restore(spark, path)
    new, old, aside = (spark._jvm.org.apache.hadoop.fs.Path(f"{path}{end}") for end in (".next", "", ".before"))
    store = old.getFileSystem(spark._jsc.hadoopConfiguration())
    rows.write.mode("overwrite").parquet(f"{path}.next")
    for source, target in ((old, aside), (new, old)):
        if store.exists(source) and not store.rename(source, target):
            raise OSError(f"can't move {source} to {target}")
    store.delete(aside, True)


def restore(spark: SparkSession, path: str) -> None:
    """Put back a table that a crash in ``overwrite`` has left aside."""
    old, aside = (spark._jvm.org.apache.hadoop.fs.Path(f"{path}{end}") for end in ("", ".before"))
    store = old.getFileSystem(spark._jsc.hadoopConfiguration())
    if store.exists(aside):
        if store.exists(old):
            store.delete(aside, True)
        else:
            store.rename(aside, old)


def put_by_key(rows: DataFrame, path: str, key: str) -> None:
    """Upsert a model or step result by one key: each key is a partition, and only those written are replaced."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def delete_owned(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows without those whose id and owner are both in ``ids``."""
    return rows.join(ids.select("id", "owner"), ["id", "owner"], "left_anti")


def read_documents(spark: SparkSession, path: str, schema: str, defaults: dict[str, Column] | None = None) -> DataFrame:
    """Nested JSON documents, with defaults for null fields."""
    docs = spark.read.schema(schema).option("multiLine", False).json(path)
    return docs.withColumns({k: F.coalesce(F.col(k), v) for k, v in (defaults or {}).items()})


def upsert_by_date(current: DataFrame, entries: DataFrame) -> DataFrame:
    """Dated entries, one per date; a replaced entry keeps its first id and creation time."""
    both = current.withColumn("__new", F.lit(0)).unionByName(entries.withColumn("__new", F.lit(1)))
    window = Window.partitionBy("date").orderBy("__new", "created_at", "id")
    whole = window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    last = Window.partitionBy("date").orderBy(F.desc("__new"), F.desc("created_at"), F.desc("id"))
    kept = both.withColumns({
        "__id": F.first("id").over(whole), "__at": F.first("created_at").over(whole), "__rank": F.row_number().over(last)
    })
    kept = kept.where("__rank = 1").withColumn("id", F.col("__id")).withColumn("created_at", F.col("__at"))
    return kept.drop("__new", "__id", "__at", "__rank").orderBy("date")


def bounded_history(current: DataFrame, new: DataFrame, most: int = 200) -> DataFrame:
    """The latest entries of both, newest first."""
    return new.unionByName(current).orderBy(F.desc("predicted_at"), F.desc("id")).limit(most)


def mark_synced(history: DataFrame, synced: DataFrame) -> DataFrame:
    """History rows with ``synced_id`` from ``synced`` (id, synced_id) where it tells one; others keep theirs."""
    return history.join(synced.withColumnRenamed("synced_id", "__new"), "id", "left").withColumn("synced_id", F.coalesce("__new", "synced_id")).drop("__new")


def by_key(rows: DataFrame, key: str, value) -> DataFrame:
    """The row with a unique key, or none."""
    return rows.where(F.col(key) == F.lit(value)).limit(1)


def dated_entries(entries: DataFrame, deleted: DataFrame | None = None) -> DataFrame:
    """Entries by date, latest first, without those whose id is in ``deleted``."""
    kept = entries.join(deleted.select("id").distinct(), "id", "left_anti") if deleted is not None else entries
    return kept.orderBy(F.desc("date"), "id")


def read_binaries(spark: SparkSession, path: str, pattern: str = "*", most_bytes: int = 8 << 20) -> DataFrame:
    """(path, length, content) of the files under ``path`` up to ``most_bytes``; larger ones are passed over."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return files.where(F.col("length") <= most_bytes).select("path", "length", "content")


def extracted(rows: DataFrame, text: str, schema: str) -> DataFrame:
    """``rows`` with ``extracted``: their JSON text under a fixed schema; null where it isn't JSON of an object."""
    parsed = F.from_json(F.col(text), schema, {"mode": "PERMISSIVE"})
    return rows.withColumn("extracted", F.when(F.col(text).rlike(r"^\s*\{") & F.get_json_object(text, "$").isNotNull(), parsed))
