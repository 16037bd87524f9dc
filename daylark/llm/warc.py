"""WARC archives as a PySpark Python data source, written and read by file partitions.

``df.write.format("warc").save(path)`` writes one ``.warc.gz`` file per task, a gzip member per
record. Each member says its own compressed and plain length in a gzip extra field, and each write
commits a manifest of its files with member offsets about every ``split_bytes``; these are the read's
partitions. Mode "append" adds to the archive, "overwrite" replaces what was committed before: its
manifest names the ones it replaces, so that readers see either the old records or the new ones.
Reading takes predicates on the record type and on header columns, inflates a member
only up to the end of its headers, and seeks past the rest unless the row is wanted and a payload
column is asked for. Files without the extra field or manifest are read too, one partition a file.

Defined cases: null payloads count as empty; a null URI writes no header and reads as null; control
characters in header values are percent-encoded. Repeated rows are written each, with equal record ids.
Empty input writes a manifest without files and reads as no rows. A failed write leaves no manifest, and
deletes the files of its finished tasks.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    In,
    InputPartition,
    StringStartsWith,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from daylark.llm.common import new_path, small_side, stored

SCHEMA = (
    "record_id string, record_type string, target_uri string, refers_to string, payload_digest string,"
    " http_length long, payload binary, payload_length long, payload_sha1 string"
)
HEADER_COLUMNS = {
    "record_id": "warc-record-id",
    "record_type": "warc-type",
    "target_uri": "warc-target-uri",
    "refers_to": "warc-refers-to",
    "payload_digest": "warc-payload-digest",
}
PAYLOAD_COLUMNS = {"payload", "payload_length", "payload_sha1"}
MANIFEST = re.compile(r"_manifest(-[0-9a-f]+)?\.json")
LEVEL = 4
_CONTROL = re.compile(r"[\x00-\x1f\x7f]")


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _clean(value: str) -> str:
    return _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", value)


def member(plain: bytes) -> bytes:
    """A gzip member with its compressed and plain length in the extra field ``sl``."""
    deflate = zlib.compressobj(LEVEL, zlib.DEFLATED, -15)
    body = deflate.compress(plain) + deflate.flush()
    tail = struct.pack("<II", zlib.crc32(plain), len(plain) & 0xFFFFFFFF)
    size = 24 + len(body) + len(tail)
    lengths = (size, len(plain)) if max(size, len(plain)) < 1 << 32 else (0, 0)  # 0: not known, to be inflated
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, *lengths) + body + tail


def record(row: dict) -> bytes:
    """The plain bytes of a WARC record; a revisit keeps the HTTP headers of the full payload only."""
    payload = row["payload"] or b""
    kind = row["record_type"]
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{_clean(row['record_id'])}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if row.get("target_uri") is not None:
        head.append(f"WARC-Target-URI: {_clean(row['target_uri'])}")
    if kind == "revisit":
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: <{_clean(row['refers_to'])}>")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    try:
        return fs.FileSystem.from_uri(path)
    except (pa.ArrowInvalid, OSError) as error:
        raise ValueError(f"WARC archives can't be kept at {path}: pyarrow.fs doesn't open it ({error})") from error


def manifests(store: fs.FileSystem, root: str) -> dict[str, dict]:
    """Each manifest that no other one replaces, by name; ``files`` with their splits and sizes."""
    names = [x.base_name for x in store.get_file_info(fs.FileSelector(root, allow_not_found=True)) if MANIFEST.fullmatch(x.base_name)]
    found = {}
    for name in names:
        with store.open_input_stream(f"{root}/{name}") as file:
            found[name] = json.loads(file.read())
    gone = {old for m in found.values() for old in m["replaces"]}
    return {name: m for name, m in found.items() if name not in gone}


@dataclass
class Written(WriterCommitMessage):
    file: str | None
    splits: list[int]
    size: int


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, split_bytes: int, overwrite: bool):
        self.path, self.split_bytes, self.overwrite = path, split_bytes, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = opened(self.path)
        name, out, at, splits = f"part-{uuid.uuid4().hex}.warc.gz", None, 0, []
        try:
            for batch in iterator:
                for k in range(batch.num_rows):
                    if out is None:
                        store.create_dir(root, recursive=True)
                        out = store.open_output_stream(f"{root}/{name}", compression=None)
                    data = member(record({c: batch.column(c)[k].as_py() for c in batch.schema.names}))
                    if not splits or at - splits[-1] >= self.split_bytes:
                        splits.append(at)
                    out.write(data)
                    at += len(data)
        except BaseException:
            if out is not None:
                out.close()
                store.delete_file(f"{root}/{name}")
            raise
        if out is not None:
            out.close()
        return Written(name if out is not None else None, splits, at)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = opened(self.path)
        store.create_dir(root, recursive=True)
        before = manifests(store, root) if self.overwrite else {}
        files = [{"file": m.file, "splits": m.splits, "size": m.size} for m in messages if m and m.file]
        with store.open_output_stream(f"{root}/_manifest-{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps({"files": files, "replaces": list(before)}).encode())
        for manifest in before.values():
            for f in manifest["files"]:
                store.delete_file(f"{root}/{f['file']}")

    def abort(self, messages: list[Written | None]) -> None:
        store, root = opened(self.path)
        for m in messages:
            if m and m.file:
                store.delete_file(f"{root}/{m.file}")


@dataclass
class Span(InputPartition):
    file: str
    start: int
    end: int


def headers_of(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines) if k}


class Member:
    """One gzip member of an open file, inflated as far as asked for."""

    def __init__(self, file, start: int, chunk: int = 16_384):
        self.file, self.start, self.chunk = file, start, chunk
        file.seek(start)
        first = file.read(24)
        self.size = 0
        if first[:4] == b"\x1f\x8b\x08\x04" and first[12:14] == b"sl":
            self.size = struct.unpack("<I", first[16:20])[0]
        self.inflate = zlib.decompressobj(31)
        self.plain = bytearray(self.inflate.decompress(first))

    def more(self) -> bool:
        if self.inflate.eof:
            return False
        data = self.file.read(self.chunk)
        if not data:
            raise EOFError(f"the record at byte {self.start} is cut off")
        self.plain += self.inflate.decompress(data)
        return True

    def until(self, mark: bytes, start: int = 0) -> int:
        """The end of ``mark`` in the plain bytes, inflating as needed; -1 if the member ends first."""
        while (at := self.plain.find(mark, start)) < 0:
            if not self.more():
                return -1
        return at + len(mark)

    def whole(self) -> bytearray:
        while self.more():
            pass
        return self.plain

    def next(self) -> int:
        """Where the next member starts: told by this one, else found by inflating it to its end."""
        if self.size:
            return self.start + self.size
        self.whole()
        return self.file.tell() - len(self.inflate.unused_data)


class WarcReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.columns = path, schema.names
        self.wanted: list[tuple[str, str, tuple[str, ...]]] = []

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in HEADER_COLUMNS and isinstance(f, EqualTo):
                self.wanted.append((name, "in", (f.value,)))
            elif name in HEADER_COLUMNS and isinstance(f, In):
                self.wanted.append((name, "in", tuple(f.value)))
            elif name in HEADER_COLUMNS and isinstance(f, StringStartsWith):
                self.wanted.append((name, "starts", (f.value,)))
            else:
                yield f

    def partitions(self) -> list[Span]:
        store, root = opened(self.path)
        kept = manifests(store, root)
        if kept:
            files = [f for name in sorted(kept) for f in kept[name]["files"]]
        else:
            found = store.get_file_info(fs.FileSelector(root))
            files = [{"file": x.base_name, "splits": [0], "size": x.size} for x in found if x.base_name.endswith(".warc.gz")]
        return [Span(f["file"], a, b) for f in files for a, b in zip(f["splits"], [*f["splits"][1:], f["size"]])] or [Span("", 0, 0)]

    def _passes(self, values: dict[str, str | None]) -> bool:
        return all(
            values[c] in among if how == "in" else (values[c] or "").startswith(among[0]) and values[c] is not None
            for c, how, among in self.wanted
        )

    def read(self, partition: Span) -> Iterator[tuple]:
        if not partition.file:
            return
        store, root = opened(self.path)
        payload_wanted = bool(PAYLOAD_COLUMNS & set(self.columns))
        with store.open_input_file(f"{root}/{partition.file}") as file:
            at = partition.start
            while at < partition.end:
                one = Member(file, at)
                end = one.until(b"\r\n\r\n")
                heads = headers_of(bytes(one.plain[: end - 4]))
                row: dict = {c: heads.get(h) for c, h in HEADER_COLUMNS.items()}
                for c in ("record_id", "refers_to"):
                    row[c] = row[c].strip("<>") if row[c] else None
                row["payload_digest"] = (row["payload_digest"] or "").removeprefix("sha1:") or None
                if self._passes(row):
                    body = one.until(b"\r\n\r\n", end)
                    http = headers_of(bytes(one.plain[end : body - 4])) if body > 0 else {}
                    row["http_length"] = int(http["content-length"]) if "content-length" in http else None
                    if payload_wanted and body > 0:
                        data = bytes(one.whole()[body : end + int(heads["content-length"])])
                        row |= {"payload": data, "payload_length": len(data)}
                        if "payload_sha1" in self.columns:
                            row["payload_sha1"] = base32_sha1(data)
                    yield tuple(row.get(c) for c in self.columns)
                at = one.next()


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        opened(self.options["path"])
        return WarcReader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        opened(self.options["path"])
        return WarcWriter(self.options["path"], int(self.options.get("split_bytes", 64 << 20)), overwrite)


def register(spark: SparkSession) -> None:
    """Make format "warc" known to the session and let it take filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def page_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0) -> DataFrame:
    """The WARC rows of ``pages``: of equal payloads of at least ``least`` bytes the largest id is the response.

    Only groups of two or more equal payloads are looked up, after partial aggregation, so payloads
    are not shuffled and a hot group leaves each task as one row. Rows with a null id are responses
    only where all ids of their group are null.
    """
    body = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("target_uri"), body.alias("payload"))
    keyed = rows.withColumn("key", F.unhex(F.sha2("payload", 256)))
    groups = keyed.where(F.octet_length("payload") >= least).groupBy("key").agg(F.max("id").alias("first"), F.count(F.lit(1)).alias("n"))
    groups = stored(groups.where("n > 1").select("key", "first"), "payload-groups")
    joined = keyed.join(small_side(groups), "key", "left")
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")))
    return joined.select(
        name("id").alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        "target_uri",
        F.when(revisit, name("first")).alias("refers_to"),
        "payload",
    )


def archive_pages(pages: DataFrame, path: str | None = None, mode: str = "append", **columns) -> str:
    """Write the pages as WARC archives (``mode`` "append" or "overwrite") and return their path.

    Duplicates are looked for within ``pages``, not among records that the path holds already.
    """
    spark = pages.sparkSession
    register(spark)
    path = path or new_path(spark, "warc")
    page_records(pages, **columns).write.format("warc").mode(mode).save(path)
    return path


def read_records(spark: SparkSession, path: str, columns: str = SCHEMA) -> DataFrame:
    register(spark)
    return spark.read.format("warc").schema(columns).load(path)
