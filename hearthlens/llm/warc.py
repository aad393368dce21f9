"""WARC archives: written by Spark's text sink, read by a Python data source.

Writing: a record is one row of text (header lines, blank line, block); the
sink's line separator is the blank-line pair that ends a WARC record, so files
are plain WARC/1.1, written with Spark's own commit protocol to any store.

Reading: ``spark.read.format("warc")`` plans partitions over files (small ones
together), parses headers first, tests pushed-down predicates on record type
and other headers against them, and steps over the payload of records that do
not match or when the schema asks for no payload.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition, IsNotNull

from hearthlens.llm.common import scratch_folder
from hearthlens.session import ship_package

#: Names and formats of the WARC 1.1 standard.
CRLF = "\r\n"
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DIGITS32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
#: columns of the source and the header each one is read from
HEADERS = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "date": "warc-date",
           "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to", "content_type": "content-type",
           "payload_length": "x-payload-length"}
SCHEMA = "record_type string, record_id string, target_uri string, date string, payload_digest string, refers_to string, content_type string, payload_length string, content_length long, payload binary"


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 (160 bits are 8 runs of 4 digits)."""
    hexes = F.sha1(data)
    runs = [F.lpad(F.conv(F.substring(hexes, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*runs), DIGITS32, BASE32)


def mark_revisits(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0) -> DataFrame:
    """page_id, url, html (null: empty), bytes, digest, refers_to.

    Of rows with equal payloads of at least ``min_bytes`` the smallest page_id
    is the response and the others refer to it (refers_to; null for
    responses).  Repeated rows with that page_id are all responses; a null
    page_id only refers.  First occurrences are counted map-side, and only digests that
    occur twice are joined back, so one frequent payload is no hot group.
    """
    body = F.coalesce(F.col(html).cast("string"), F.lit(""))
    p = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), body.alias("html"))
    p = p.withColumn("bytes", F.octet_length("html").cast("long")).withColumn("digest", base32_sha1(F.col("html").cast("binary")))
    first = (p.where(F.col("bytes") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
             .where("n > 1 and first is not null").select(F.col("digest").alias("d"), "first"))
    return (p.join(first, F.col("digest") == F.col("d"), "left")
            .select("page_id", "url", "html", "bytes", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to")))


def _urn(c: Column) -> Column:
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))


def record_text(date: str = "1970-01-01T00:00:00Z") -> Column:
    """The record of a row of ``mark_revisits`` without its closing blank
    lines.  A revisit holds the HTTP head alone.  Control characters and
    blanks of the url are percent-coded, since a header is one line."""
    url = F.regexp_replace(F.col("url"), " ", "%20")
    url = F.regexp_replace(url, r"[\x00-\x1F\x7F]", "%0A")
    uri = F.coalesce(F.concat(F.lit("WARC-Target-URI: "), url, F.lit(CRLF)), F.lit(""))
    again = F.col("refers_to").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(CRLF * 2))
    block = F.when(again, http).otherwise(F.concat(http, "html"))
    extra = F.when(again, F.concat(F.lit(f"WARC-Profile: {PROFILE}{CRLF}WARC-Refers-To: "), _urn(F.col("refers_to")), F.lit(CRLF))).otherwise(F.lit(""))
    return F.concat(F.lit(f"{VERSION}{CRLF}WARC-Type: "), F.when(again, F.lit("revisit")).otherwise(F.lit("response")),
                    F.lit(f"{CRLF}WARC-Record-ID: "), _urn(F.col("page_id")), F.lit(f"{CRLF}WARC-Date: {date}{CRLF}"), uri, extra,
                    F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"), F.lit(f"{CRLF}X-Payload-Length: "), F.col("bytes").cast("string"),
                    F.lit(f"{CRLF}Content-Type: application/http;msgtype=response{CRLF}Content-Length: "), F.octet_length(block).cast("string"),
                    F.lit(CRLF * 2), block)


def write_warc(marked: DataFrame, path: str, records_per_file: int = 50_000, compression: str = "gzip") -> None:
    """Writes rows of ``mark_revisits`` as WARC files below ``path`` (gzip or
    none; the reader takes both)."""
    (marked.select(record_text().alias("value")).write.option("lineSep", CRLF * 2).option("compression", compression)
     .option("maxRecordsPerFile", str(records_per_file)).text(path))


class _Files(InputPartition):
    def __init__(self, files: list[str]):
        super().__init__(files)
        self.files = files


def _open_fs(path: str):
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


class WarcReader(DataSourceReader):
    """Options: path (file or folder), partition_bytes, batch_bytes."""

    def __init__(self, names: list[str], options: dict):
        self.names, self.path = names, options["path"]
        self.partition_bytes = int(options.get("partition_bytes", 64 << 20))
        self.batch_bytes = int(options.get("batch_bytes", 8 << 20))
        self.tests: list[tuple[str, frozenset]] = []

    def pushFilters(self, filters):
        """Takes equality and IN tests on header columns; leaves the rest to Spark."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if isinstance(f, EqualTo) and name in HEADERS:
                self.tests.append((HEADERS[name], frozenset([f.value])))
            elif isinstance(f, In) and name in HEADERS:
                self.tests.append((HEADERS[name], frozenset(f.value)))
            elif isinstance(f, IsNotNull) and name in HEADERS:
                self.tests.append((HEADERS[name], frozenset()))
            else:
                yield f

    def partitions(self):
        fs, path = _open_fs(self.path)
        info = fs.get_file_info(path)
        found = [info] if info.is_file else fs.get_file_info(pafs.FileSelector(path, recursive=True))
        files = sorted((f.path, f.size) for f in found if f.is_file and not f.base_name.startswith(("_", ".")))
        out, run, size = [], [], 0
        for name, n in files:
            if run and size + n > self.partition_bytes:
                out.append(_Files(run))
                run, size = [], 0
            run.append(name)
            size += n
        return out + ([_Files(run)] if run else [_Files([])] if not out else [])

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        fs, _ = _open_fs(self.path)
        types = {"payload": pa.binary(), "content_length": pa.int64()}
        schema = pa.schema([(n, types.get(n, pa.string())) for n in self.names])
        rows: dict[str, list] = {n: [] for n in self.names}
        size = 0
        for name in partition.files:
            raw = fs.open_input_file(name)
            zipped = name.endswith(".gz")
            with io.BufferedReader(gzip.GzipFile(fileobj=raw) if zipped else raw, 1 << 20) as f:
                for head, payload in self._records(f):
                    for n in self.names:
                        rows[n].append(payload if n == "payload" else int(head.get("content-length", 0)) if n == "content_length" else head.get(HEADERS[n]))
                    size += len(payload or b"") + 500
                    if size >= self.batch_bytes:
                        yield pa.RecordBatch.from_pydict(rows, schema=schema)
                        rows, size = {n: [] for n in self.names}, 0
        if size:
            yield pa.RecordBatch.from_pydict(rows, schema=schema)

    def _records(self, f) -> Iterator[tuple[dict, bytes | None]]:
        """(headers, payload or None) of the records that pass the tests."""
        want = "payload" in self.names
        while line := f.readline():
            if not line.strip():
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError(f"no WARC record starts with {line[:40]!r}")
            head: dict[str, str] = {}
            while (line := f.readline()).strip():
                key, _, value = line.decode("utf-8", "replace").partition(":")
                head[key.strip().lower()] = value.strip()
            n = int(head.get("content-length", 0))
            if any((v := head.get(k)) is None or (allowed and v not in allowed) for k, allowed in self.tests):
                self._skip(f, n)
            elif not want:
                self._skip(f, n)
                yield head, None
            else:
                block = f.read(n)
                if head.get("content-type", "").startswith("application/http"):
                    block = block.partition(b"\r\n\r\n")[2]
                yield head, block

    @staticmethod
    def _skip(f, n: int) -> None:
        """Steps over a block without decoding it."""
        if f.seekable():
            f.seek(n, io.SEEK_CUR)
        else:
            while n > 0 and (got := len(f.read(min(n, 1 << 20)))):
                n -= got


class WarcDataSource(DataSource):
    """``spark.read.format("warc").load(path)``; a schema with fewer columns
    makes the reader decode only those."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        unknown = [f for f in schema.fieldNames() if f not in HEADERS and f not in ("payload", "content_length")]
        if unknown:
            raise ValueError(f"no such column in a WARC source: {unknown}")
        return WarcReader(schema.fieldNames(), dict(self.options))


def read_warc(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    ship_package(spark)
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    types = dict(c.strip().split(" ") for c in SCHEMA.split(","))
    return spark.read.format("warc").schema(", ".join(f"{c} {types[c]}" for c in columns or types)).load(path)


def _id_of(urn: Column) -> Column:
    return F.regexp_extract(urn, "^<urn:x-page:(.*)>$", 1).try_cast("long")


def round_trip(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0, path: str | None = None) -> DataFrame:
    """Writes the pages as WARC files, reads them back, and returns per page:
    page_id, payload_bytes, payload_digest, record_type, refers_to.

    Responses are measured on the payload that was read; revisits, whose
    payload is elsewhere, on their headers alone.  Null html is an empty
    payload, a null url has no target header, repeated rows stay, an empty
    table gives no rows, other columns are ignored.
    """
    spark = pages.sparkSession
    path = path or scratch_folder(spark, "warc")
    write_warc(mark_revisits(pages, page_id, url, html, min_bytes), path)
    full = read_warc(spark, path, ["record_type", "record_id", "payload"]).where("record_type = 'response'")
    full = full.select(_id_of(F.col("record_id")).alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"),
                       base32_sha1(F.col("payload")).alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    heads = read_warc(spark, path, ["record_type", "record_id", "payload_digest", "refers_to", "payload_length"]).where("record_type = 'revisit'")
    heads = heads.select(_id_of(F.col("record_id")).alias("page_id"), F.col("payload_length").cast("long").alias("payload_bytes"),
                         F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"), "record_type", _id_of(F.col("refers_to")).alias("refers_to"))
    return full.unionByName(heads)
