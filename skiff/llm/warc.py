"""WARC archives: a writer on Spark's text sink and a Python data source.

Writing: a record is a header block, a blank line and its content; records end
with two CRLF, which is the line separator given to Spark's text sink, so
archives go through its commit protocol to any file system, and a lost task
leaves nothing behind.  Of records with equal payloads of at least
``revisit_bytes`` the one with the largest id is written whole as ``response``;
the others become ``revisit`` records that name it.  Which payloads repeat is
found on (digest, size) counts alone.  The repeated ones are counted: up to
``BROADCAST_ROWS`` of them (about 100 bytes each) are broadcast, and payloads
move nowhere; more are joined by a shuffle.

Reading (``spark.read.format("warc")``): files are listed and planned into
partitions of about ``split_bytes`` on the driver; equality, IN and null
predicates on the header columns are pushed into the reader.  Of each record the
headers are parsed first; a record that the predicates refuse, or whose type is
not in ``payload_types``, is passed over by seeking, and its content is neither
read nor decoded.  Plain and gzip archives are read.  A file is one task's work
at most, streamed record by record; writers bound the size of files.

Defined cases: a null payload is empty; a null id writes an empty record id and
is never referred to unless all ids of its group are null, when all are
responses; equal rows are equal records (several rows with the largest id are
all responses); a null or broken target URI is left out or has its line breaks
escaped; an empty folder has no records; extra columns are ignored.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull

from skiff.llm.common import kept, narrow

CRLF = "\r\n"
#: Fixed names of the format; the payload's size is an extension field, as a revisit has no payload to count.
VERSION = "WARC/1.1"
HTTP = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}{CRLF}"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID = "urn:page:"
BROADCAST_ROWS = 200_000
#: Columns of the data source and the header field of each.
FIELDS = {
    "record_type": "warc-type",
    "record_id": "warc-record-id",
    "target_uri": "warc-target-uri",
    "date": "warc-date",
    "payload_digest": "warc-payload-digest",
    "refers_to": "warc-refers-to",
    "declared_bytes": "x-payload-length",
}
SCHEMA = ", ".join(f"{c} string" for c in FIELDS) + ", content_length long, payload binary, file string, offset long"


def with_revisits(rows: DataFrame, revisit_bytes: int = 1000) -> DataFrame:
    """(id, payload, uri) with payload_bytes, payload_digest (hex SHA-1), record_type and refers_to."""
    raw = F.col("payload").cast("binary")
    rows = rows.withColumn("payload", F.coalesce(F.col("payload"), F.lit(""))).withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha1(raw)})
    again = rows.filter(F.col("payload_bytes") >= revisit_bytes).groupBy("payload_digest", "payload_bytes").agg(F.max("id").alias("whole"), F.count("*").alias("n")).filter("n > 1 and whole is not null").drop("n")
    again = kept(again, "repeated")
    few = again.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    out = rows.join(F.broadcast(again) if few else again, ["payload_digest", "payload_bytes"], "left")
    revisit = F.col("whole").isNotNull() & ~F.col("id").eqNullSafe(F.col("whole"))
    return out.withColumns({"record_type": F.when(revisit, "revisit").otherwise("response"), "refers_to": F.when(revisit, F.col("whole"))}).drop("whole")


def write_warc(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", revisit_bytes: int = 1000, max_records: int = 20_000, id_column: str = "page_id", uri_column: str = "url", payload_column: str = "html") -> None:
    """One record per row below ``path``, at most ``max_records`` to a file."""
    rows = with_revisits(narrow(pages, id_column, uri_column, payload_column).toDF("id", "uri", "payload"), revisit_bytes)
    revisit = F.col("record_type") == "revisit"
    block = F.concat(F.lit(HTTP), F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    name = lambda c: F.concat(F.lit(f"<{ID}"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    line = lambda field, value: F.concat(F.lit(f"{field}: "), value, F.lit(CRLF))
    uri = F.regexp_replace(F.regexp_replace("uri", "\r", "%0D"), "\n", "%0A")
    record = F.concat(
        F.lit(VERSION + CRLF),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", name(F.col("id"))),
        F.lit(f"WARC-Date: {date}{CRLF}"),
        F.coalesce(line("WARC-Target-URI", uri), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        line("X-Payload-Length", F.col("payload_bytes").cast("string")),
        F.when(revisit, F.concat(line("WARC-Refers-To", name(F.col("refers_to"))), F.lit(f"WARC-Profile: {PROFILE}{CRLF}"))).otherwise(F.lit("")),
        F.lit(f"Content-Type: application/http; msgtype=response{CRLF}"),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit(CRLF),
        block,
    )
    rows.select(record.alias("value")).write.option("lineSep", CRLF + CRLF).option("maxRecordsPerFile", max_records).text(path)


class WarcFiles(InputPartition):
    def __init__(self, files: list[str]):
        self.files = files


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.split_bytes = int(options.get("split_bytes", 64 << 20))
        self.batch_bytes = int(options.get("batch_bytes", 4 << 20))
        self.payload_types = {x.strip() for x in options.get("payload_types", "response,resource,conversion").split(",")}
        self.wanted: list[tuple[str, object]] = []  # column and: a set of values, or whether it must be null

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality, IN and null tests on header columns are kept; the rest goes back to Spark."""
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if column in FIELDS and isinstance(f, (EqualTo, EqualNullSafe)) and f.value is not None:
                self.wanted.append((column, {f.value}))
            elif column in FIELDS and isinstance(f, In):
                self.wanted.append((column, set(f.value) - {None}))
            elif column in FIELDS and isinstance(f, (IsNull, IsNotNull)):
                self.wanted.append((column, isinstance(f, IsNull)))
            else:
                yield f

    def partitions(self) -> list[WarcFiles]:
        store, top = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)
        found = store.get_file_info(fs.FileSelector(top, recursive=True)) if store.get_file_info(top).type == fs.FileType.Directory else [store.get_file_info(top)]
        files = sorted((f.path, f.size) for f in found if f.is_file and f.size and not f.base_name.startswith(("_", ".")))
        out: list[WarcFiles] = []
        room = 0
        for path, size in files:
            if size > room:
                out.append(WarcFiles([]))
                room = self.split_bytes
            out[-1].files.append(path)
            room -= size
        return out or [WarcFiles([])]

    def read(self, partition: WarcFiles) -> Iterator[pa.RecordBatch]:
        store = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path or self.path.startswith("file:") else fs.LocalFileSystem()
        rows: list[tuple] = []
        held = 0
        for path in partition.files:
            with store.open_input_file(path) as raw:
                f = gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else io.BufferedReader(raw, 1 << 20)
                for row, size in self.records(f, path):
                    rows.append(row)
                    held += size + 500
                    if held >= self.batch_bytes:
                        yield _batch(rows)
                        rows, held = [], 0
        if rows:
            yield _batch(rows)

    def records(self, f, path: str) -> Iterator[tuple[tuple, int]]:
        while True:
            offset = f.tell()
            line = f.readline()
            if not line:
                return
            if line in (b"\r\n", b"\n"):
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError(f"{path}: no record at {offset}")
            fields: dict[str, str] = {}
            while (line := f.readline()) not in (b"\r\n", b"\n", b""):
                key, _, value = line.partition(b":")
                fields[key.decode().strip().lower()] = value.decode("utf-8", "replace").strip()
            size = int(fields["content-length"])
            if not all((fields.get(FIELDS[c]) is None) == v if isinstance(v, bool) else fields.get(FIELDS[c]) in v for c, v in self.wanted):
                f.seek(size, 1)
                continue
            payload = None
            if fields.get("warc-type") in self.payload_types:
                payload = f.read(size)
                if fields.get("content-type", "").startswith("application/http"):
                    payload = payload.partition(b"\r\n\r\n")[2]
            else:
                f.seek(size, 1)
            yield (*(fields.get(k) for k in FIELDS.values()), size, payload, path, offset), len(payload or b"")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [*[pa.string()] * len(FIELDS), pa.int64(), pa.binary(), pa.string(), pa.int64()]
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[*FIELDS, "content_length", "payload", "file", "offset"])


class WarcSource(DataSource):
    """``spark.read.format("warc").load(path)``; options ``payload_types``, ``split_bytes``, ``batch_bytes``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)


def read_warc(spark: SparkSession, path: str, **options: str) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").options(**options).load(path)


def payload_figures(records: DataFrame) -> DataFrame:
    """Per record: record_id, payload_bytes and payload_digest (counted from the payload
    where there is one, else as declared), record_type, refers_to."""
    has = F.col("payload").isNotNull()
    return records.select(
        "record_id",
        F.when(has, F.octet_length("payload").cast("long")).otherwise(F.col("declared_bytes").cast("long")).alias("payload_bytes"),
        F.when(has, F.sha1("payload")).otherwise(F.regexp_replace("payload_digest", "^sha1:", "")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )


def page_of(column: str):
    """The id in a record id that ``write_warc`` made, as a long."""
    return F.regexp_extract(column, f"^<{ID}(-?[0-9]+)>$", 1).try_cast("long")


def oracle_sql(revisit_bytes: int = 1000) -> str:
    return f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_bytes, payload_digest) AS whole FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= {revisit_bytes} AND page_id <> whole THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {revisit_bytes} AND page_id <> whole THEN whole END AS refers_to
FROM g
"""
