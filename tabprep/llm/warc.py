"""WARC archives as a Python data source.

Writing: one record per page; its block is a short HTTP header and the payload. Each task writes one file per commit, under a new name
for each attempt; the commit lists the files of successful tasks in a manifest, with places where a reader may begin.

Reading: partitions are ranges of whole records, from the manifests' places, or whole files where there is no manifest. Filters on
record_type, page_id, url, payload_digest and payload_bytes (equality, sets, order, null tests and prefixes) are pushed down
(Spark does so with spark.sql.python.filterPushdown.enabled): the reader parses a record's header first, and skips the payload
of a record that the filters reject, or of all records when the column payload isn't asked for (option payload, false by default).
Files ending in .gz are read, and written with the option gzip, with each record compressed on its own.

Defined results: null html is an empty payload, null urls have no header; pages with null ids are written, with their ids absent.
Of records with equal payloads of at least ``revisit_from`` bytes all but those with the largest page_id are revisits (repeated
rows of that page are responses each); an empty table gives an archive without records.
"""

from __future__ import annotations

import gzip
import io
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
    StringStartsWith,
    WriterCommitMessage,
)
from pyspark.sql.types import BinaryType, StructType

from .files import place, reader, writer
from .shared import shared_dir, stash

_COLUMNS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"
#: A reader may begin after so many bytes of an archive.
SPLIT = 16 << 20
_PAGE = "urn:x-page:"


def _header(row: dict, n: int) -> tuple[bytes, bytes]:
    """The record's header, and the block's own."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", "WARC-Date: 1970-01-01T00:00:00Z", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{row['payload_digest']}"]
    if row["page_id"] is not None:
        lines.append(f"X-Page: <{_PAGE}{row['page_id']}>")
    if row["url"] is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda c: f"%{ord(c[0]):02X}", row["url"]))
    if row["refers_to"] is not None:
        lines += [f"WARC-Refers-To: <{_PAGE}{row['refers_to']}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines.append(f"Content-Length: {len(block) + n}")
    return ("\r\n".join(lines) + "\r\n\r\n").encode(), block


def _page(value: str | None) -> int | None:
    return int(value[len(_PAGE) + 1 : -1]) if value else None


@dataclass
class Written(WriterCommitMessage):
    path: str = ""
    records: int = 0
    places: list = field(default_factory=list)


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.folder, self.gzip = options["path"].rstrip("/"), str(options.get("gzip", "false")).lower() == "true"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        done = Written(path=f"{self.folder}/{uuid.uuid4().hex}.warc{'.gz' if self.gzip else ''}")
        at, begun = 0, 0
        out = None
        for batch in iterator:
            out = out or writer(done.path)
            payloads = batch.column(batch.schema.names.index("payload"))
            for row, payload in zip(batch.drop_columns(["payload"]).to_pylist(), payloads, strict=True):
                body = payload.as_py() or b"" if row["record_type"] == "response" else b""
                head, block = _header(row, len(body))
                record = head + block + body + b"\r\n\r\n"
                record = gzip.compress(record, 6) if self.gzip else record
                if not done.places or at - begun >= SPLIT:
                    done.places.append([at, 0])
                    begun = at
                out.write(record)
                at += len(record)
                done.records += 1
                done.places[-1][1] += 1
        if out:
            out.close()
        return done

    def commit(self, messages) -> None:
        files = [[m.path, m.places] for m in messages if m is not None and m.records]
        with writer(f"{self.folder}/manifest-{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps(files).encode())

    def abort(self, messages) -> None:
        """Files of failed jobs are in no manifest, so readers never see them."""


@dataclass
class Records(InputPartition):
    path: str
    at: int
    count: int

    def __init__(self, path: str, at: int, count: int):
        super().__init__(None)
        self.path, self.at, self.count = path, at, count


class WarcReader(DataSourceReader):
    _PUSHED = {
        EqualTo: lambda v, x: v is not None and v == x,
        EqualNullSafe: lambda v, x: v == x,
        In: lambda v, x: v is not None and v in x,
        GreaterThan: lambda v, x: v is not None and v > x,
        GreaterThanOrEqual: lambda v, x: v is not None and v >= x,
        LessThan: lambda v, x: v is not None and v < x,
        LessThanOrEqual: lambda v, x: v is not None and v <= x,
        StringStartsWith: lambda v, x: v is not None and v.startswith(x),
    }

    def __init__(self, schema: StructType, options: dict):
        self.names = schema.names
        self.folder = options["path"].rstrip("/")
        self.payload = any(isinstance(f.dataType, BinaryType) for f in schema.fields)
        self.arrow = pa.schema([(f.name, pa.binary() if isinstance(f.dataType, BinaryType) else pa.int64() if f.dataType.typeName() == "long" else pa.string()) for f in schema.fields])
        self.filters: list[tuple[str, object, object]] = []

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in self.names and name != "payload" and (type(f) in self._PUSHED or isinstance(f, IsNull | IsNotNull)):
                self.filters.append((name, type(f), getattr(f, "value", None)))
            else:
                yield f

    def partitions(self) -> list[Records]:
        system, path = place(self.folder)
        names = sorted(x.base_name for x in system.get_file_info(fs.FileSelector(path)) if x.type == fs.FileType.File)
        out = []
        manifests = [n for n in names if n.startswith("manifest-")]
        for n in manifests:
            with reader(f"{self.folder}/{n}") as f:
                out += [Records(file, at, count) for file, places in json.loads(f.read()) for at, count in places]
        if not manifests:
            out = [Records(f"{self.folder}/{n}", 0, -1) for n in names if n.endswith((".warc", ".warc.gz"))]
        return out or [Records("", 0, 0)]

    def _wanted(self, row: dict) -> bool:
        for name, kind, value in self.filters:
            v = row[name]
            if (v is not None) if kind is IsNull else (v is None) if kind is IsNotNull else not self._PUSHED[kind](v, value):
                return False
        return True

    def read(self, partition: Records) -> Iterator[pa.RecordBatch]:
        if not partition.count:
            return
        raw = reader(partition.path)
        raw.seek(partition.at)
        file = io.BufferedReader(gzip.GzipFile(fileobj=raw) if partition.path.endswith(".gz") else raw, 1 << 20)
        rows: list[dict] = []
        size = n = 0
        while n != partition.count:
            start = file.readline()
            while start == b"\r\n":
                start = file.readline()
            if not start:
                break
            n += 1
            head = _fields(file)
            length = int(head.get("content-length", 0))
            block = _http(file) if head.get("content-type", "").startswith("application/http") else (0, {})
            left = length - block[0]
            row = {
                "page_id": _page(head.get("x-page")),
                "url": head.get("warc-target-uri"),
                "record_type": head.get("warc-type"),
                "refers_to": _page(head.get("warc-refers-to")),
                "payload_bytes": int(block[1].get("content-length", left)),
                "payload_digest": head.get("warc-payload-digest", "").removeprefix("sha1:") or None,
            }
            wanted = self._wanted(row)
            if wanted and self.payload:
                row["payload"] = file.read(left)
                size += left
            else:
                file.seek(left, io.SEEK_CUR)
            if wanted:
                rows.append(row)
            if len(rows) >= 5000 or size >= 8 << 20:
                yield pa.RecordBatch.from_pylist([{k: r.get(k) for k in self.names} for r in rows], self.arrow)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist([{k: r.get(k) for k in self.names} for r in rows], self.arrow)


def _fields(file) -> dict[str, str]:
    """Header lines up to the empty one, by lower-cased name."""
    out: dict[str, str] = {}
    while (line := file.readline()) not in (b"\r\n", b"\n", b""):
        name, _, value = line.decode("utf-8", "replace").partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def _http(file) -> tuple[int, dict[str, str]]:
    """Length and fields of the HTTP header that a block begins with."""
    n, out = 0, {}
    while True:
        line = file.readline()
        n += len(line)
        if line in (b"\r\n", b"\n", b""):
            return n, out
        name, colon, value = line.decode("latin-1").partition(":")
        if colon:
            out[name.strip().lower()] = value.strip()


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return _COLUMNS + (", payload binary" if str(self.options.get("payload", "false")).lower() == "true" else "")

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(schema, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the format known to a session and lets it push filters down."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def page_records(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_from: int = 1000, broadcast_digests: int = 100_000) -> DataFrame:
    """The records to write: which pages revisit which. Payloads aren't shuffled while there are few repeated digests."""
    payload = F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.select("*", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"))
    repeated = rows.where(F.col("payload_bytes") >= revisit_from).groupBy("payload_digest").agg(F.max("page_id").alias("_latest"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    repeated = stash(repeated.select(F.col("payload_digest").alias("_digest"), "_latest"))
    few = repeated.limit(broadcast_digests + 1).count() <= broadcast_digests
    joined = rows.join(F.broadcast(repeated) if few else repeated, F.col("payload_digest") == F.col("_digest"), "left")
    revisit = F.coalesce(F.col("page_id") < F.col("_latest"), F.lit(False))
    return joined.select("page_id", "url", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("_latest")).alias("refers_to"), "payload_bytes", "payload_digest", F.when(~revisit, F.col("payload")).alias("payload"))


def write_warc(pages: DataFrame, folder: str, *, compress: bool = False, **columns) -> None:
    """Writes an archive folder of all pages."""
    register(pages.sparkSession)
    page_records(pages, **columns).write.format("warc").mode("append").option("gzip", str(compress).lower()).save(folder)


def read_warc(spark: SparkSession, folder: str, *, payload: bool = False) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(folder)


def op7_warc(spark, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/warc"
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    # responses are read with their payloads, which give length and digest anew; revisits by their headers alone
    full = read_warc(spark, folder, payload=True).where("record_type = 'response'")
    full = full.select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), "record_type", "refers_to")
    brief = read_warc(spark, folder).where("record_type = 'revisit'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return full.unionByName(brief)


OP7_SQL = r"""
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT payload_digest, max(page_id) AS latest FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT p.page_id, p.payload_bytes, p.payload_digest, CASE WHEN p.page_id < m.latest THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN p.page_id < m.latest THEN m.latest END AS refers_to
FROM p LEFT JOIN m USING (payload_digest)
"""
