"""WARC archives: a Spark data source that plans file partitions and parses headers before payloads.

Writing needs no Python: a record is one text value and the record terminator is the line separator, so
Spark's text writer commits whole files through Hadoop's file systems, compressed if asked.
Reading is a Python data source. Files are packed into partitions by size; a record's headers are parsed
first, the pushed predicates decide on them, and the block of an unwanted record is passed over (by
a seek in plain files) without being decoded. An archive file is read by one task, as a stream; write_pages bounds
the records of a file.

Defined cases of write_pages: a null payload is empty; a null url gives no target header; a null id ranks below all others; of rows
that share digest and largest id every one is a response; an empty table gives an empty archive; other columns are left out.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull,
    LessThan, LessThanOrEqual, StringStartsWith,
)

from panelwright.llm.common import shared_dir, stage

PARTITION_BYTES = 32 << 20
BATCH_BYTES = 8 << 20
BLOCK = 1 << 20
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

SCHEMA = ("record_id string, record_type string, target_uri string, warc_date string, declared_digest string, refers_to string, "
          "content_length bigint, headers map<string,string>, payload_bytes bigint, payload_digest string, payload binary")
_ARROW = pa.schema([
    ("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("warc_date", pa.string()),
    ("declared_digest", pa.string()), ("refers_to", pa.string()), ("content_length", pa.int64()),
    ("headers", pa.map_(pa.string(), pa.string())), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()),
])
#: Columns that come from a header alone, and so can decide before the payload is read.
_HEADER = {
    "record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "warc_date": "warc-date",
    "declared_digest": "warc-payload-digest", "refers_to": "warc-refers-to", "content_length": "content-length",
}


# --- writing -----------------------------------------------------------------------------------

def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1: eight groups of twenty bits, each four characters."""
    digest, parts = F.sha1(payload), []
    for i in range(8):
        bits = F.conv(F.substring(digest, 5 * i + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            parts.append(F.lit(_BASE32).substr(F.shiftright(bits, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1)))
    return F.concat(*parts)


def with_revisits(pages: DataFrame, page_id: str, payload: str, min_bytes: int = 0) -> DataFrame:
    """page_id, url columns and payload, with digest, n_bytes and winner (the id that is the response of a repeated payload, else null).

    Only payloads that occur more than once reach the join; their table is written first, so that Spark knows its size and broadcasts
    it when it is small enough, and payloads then are not shuffled at all.
    """
    rows = pages.withColumn("digest", base32_sha1(F.col(payload))).withColumn("n_bytes", F.octet_length(payload).cast("long"))
    repeated = (rows.filter(F.col("n_bytes") >= min_bytes).groupBy("digest")
                .agg(F.max(page_id).alias("winner"), F.count(F.lit(1)).alias("n")).filter("n > 1")
                .select("digest", "winner", F.lit(True).alias("repeated")))
    return (rows.join(stage(repeated, "warc-repeats"), "digest", "left")
            .withColumn("revisit", F.col("repeated").isNotNull() & (F.col("n_bytes") >= min_bytes) & ~F.col(page_id).eqNullSafe(F.col("winner"))))


def write_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0,
                date: str = "1970-01-01T00:00:00Z", records_per_file: int = 100_000, compression: str = "gzip") -> str:
    """Write a record per row to a new shared folder and return it. Repeated payloads become revisits of the largest id's response."""
    path = shared_dir(pages.sparkSession, "warc")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(payload), F.lit("")).alias("payload"))
    rows = with_revisits(rows, "page_id", "payload", min_bytes)

    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"\r\n{name}: "), value)

    def record(page: Column) -> Column:
        return F.concat(F.lit("<urn:x-page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(">"))

    uri = F.regexp_replace(F.regexp_replace(F.col("url"), "\r", "%0D"), "\n", "%0A")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n_bytes").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(F.col("revisit"), http).otherwise(F.concat(http, F.col("payload")))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response")),
        line("WARC-Record-ID", record(F.col("page_id"))), line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", uri), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(F.col("revisit"), F.concat(line("WARC-Refers-To", record(F.col("winner"))), line("WARC-Profile", F.lit(_PROFILE)))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response"),
        line("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n\r\n"))
    (rows.select(F.concat(head, block).alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", compression)
     .option("maxRecordsPerFile", records_per_file).text(path))
    return path


# --- reading -----------------------------------------------------------------------------------

@dataclass
class FilePartition(InputPartition):
    files: list[str]


def _test(f: Filter) -> Callable[[Any], bool] | None:
    """What a pushed predicate asks of a header's value, or None where it can't be answered from headers."""
    value = getattr(f, "value", None)
    tests = {
        EqualTo: lambda x: x == value, In: lambda x: x in value, IsNotNull: lambda x: True, StringStartsWith: lambda x: x.startswith(value),
        GreaterThan: lambda x: x > value, GreaterThanOrEqual: lambda x: x >= value, LessThan: lambda x: x < value,
        LessThanOrEqual: lambda x: x <= value,
    }
    return tests.get(type(f))


class WarcReader(DataSourceReader):
    """options: path; payload = none (headers only), digest (length and SHA-1 of the payload) or full."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.payload = options.get("payload", "full")
        self.partition_bytes = int(options.get("partitionBytes", PARTITION_BYTES))
        self.filters: list[Filter] = []
        if self.payload not in ("none", "digest", "full"):
            raise ValueError(f"payload must be none, digest or full, not {self.payload}")

    def partitions(self) -> Sequence[InputPartition]:
        store, root = pafs.FileSystem.from_uri(self.path)
        info = store.get_file_info(root)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.is_file else store.get_file_info(pafs.FileSelector(root, recursive=True))
        files = sorted((x.path, x.size) for x in found if x.is_file and x.base_name[0] not in "._")
        groups, room = [], 0
        for name, size in files:
            if size > room or not groups:
                groups.append([])
                room = self.partition_bytes
            groups[-1].append(name)
            room -= size
        return [FilePartition(g) for g in groups] or [FilePartition([])]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        store, _ = pafs.FileSystem.from_uri(self.path)
        rows, held = [], 0
        for name in partition.files:
            with store.open_input_file(name) as raw:
                for row in self.records(raw, name):
                    rows.append(row)
                    held += 600 + len(row["payload"] or b"")
                    if held > BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, _ARROW)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _ARROW)

    def records(self, raw: Any, name: str) -> Iterator[dict]:
        zipped = raw.read(2) == b"\x1f\x8b"
        raw.seek(0)
        stream = gzip.GzipFile(fileobj=raw) if zipped else raw
        stream = io.BufferedReader(stream, BLOCK)
        checks = [(f.attribute[0], _test(f)) for f in self.filters]
        while (version := stream.readline()):
            if not version.strip():
                continue  # between records
            if not version.startswith(b"WARC/"):
                raise ValueError(f"{name}: a record should begin here, not {version[:40]!r}")
            headers, last = {}, None
            while (text := stream.readline()).strip():
                if text[:1] in b" \t" and last:
                    headers[last] += " " + text.decode("utf-8", "replace").strip()
                    continue
                last, _, value = text.decode("utf-8", "replace").partition(":")
                last = last.strip().lower()
                headers[last] = value.strip()
            length = int(headers["content-length"])
            row = {c: headers.get(h) for c, h in _HEADER.items()} | {"content_length": length}
            if all(row[c] is not None and ok(row[c]) for c, ok in checks):
                yield row | self.block(stream, headers, length, name) | {"headers": list(headers.items())}
            else:
                self.skip(stream, length, zipped, name)

    def block(self, stream: io.BufferedReader, headers: dict[str, str], length: int, name: str) -> dict:
        """Payload columns: from the HTTP head alone where the payload isn't asked for or, as in a revisit, isn't there."""
        http, read, said = headers.get("content-type", "").startswith("application/http"), 0, None
        while http and read < length and (text := stream.readline()):
            read += len(text)
            if not text.strip():
                break
            if text.lower().startswith(b"content-length:"):
                said = int(text.partition(b":")[2])
        absent = headers.get("warc-type") == "revisit"
        out = {"payload_bytes": said if http else length, "payload_digest": None, "payload": None}
        if self.payload == "none" or absent:
            self.skip(stream, length - read, False, name)
            return out
        sha, kept, left = hashlib.sha1(), [], length - read
        while left:
            part = stream.read(min(left, BLOCK))
            if not part:
                raise ValueError(f"{name} ends inside a record")
            sha.update(part)
            left -= len(part)
            if self.payload == "full":
                kept.append(part)
        return {"payload_bytes": length - read, "payload_digest": base64.b32encode(sha.digest()).decode(),
                "payload": b"".join(kept) if self.payload == "full" else None}

    def skip(self, stream: io.BufferedReader, length: int, zipped: bool, name: str) -> None:
        if length > BLOCK and not zipped and not isinstance(stream.raw, gzip.GzipFile):
            stream.seek(length, io.SEEK_CUR)
            return
        while length:
            part = len(stream.read(min(length, BLOCK)))
            if not part:
                raise ValueError(f"{name} ends inside a record")
            length -= part


class WarcPushdownReader(WarcReader):
    """The reader where Spark may push predicates; it needs PUSHDOWN to be on in the session."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if len(f.attribute) == 1 and f.attribute[0] in _HEADER and _test(f):
                self.filters.append(f)
            else:
                yield f


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: Any) -> DataSourceReader:
        return (WarcPushdownReader if self.options.get("pushdown") == "true" else WarcReader)(self.options)


def read(spark: SparkSession, path: str, payload: str = "full") -> DataFrame:
    """Records of the archives under a path. Filters on the header columns are pushed into the reader if the session's PUSHDOWN is on."""
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("payload", payload).option("pushdown", spark.conf.get(PUSHDOWN, "false")).load(path)


def page_of(record: str | Column) -> Column:
    """The id in a record name that write_pages gave, null for none."""
    return F.regexp_extract(record, r"^<urn:x-page:(-?\d+)>$", 1).try_cast("long")
