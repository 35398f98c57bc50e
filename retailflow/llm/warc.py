"""WARC archives: records of pages with revisits for equal payloads, and a data source that reads them."""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    Filter,
    In,
    InputPartition,
    IsNotNull,
    StringStartsWith,
)

from retailflow.llm.common import columns, data_files, file_system, new_folder, salted_totals, salts, unused, without

#: Payloads of at least so many bytes may become revisits.
LEAST_REVISIT_BYTES = 1000
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"
#: Records without a stated capture time carry this one, so that reruns write equal bytes.
CAPTURED = "2024-01-01T00:00:00Z"

HEADERS = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri",
           "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}
SCHEMA = ("record_type string, record_id string, target_uri string, payload_digest string, refers_to string, "
          "page_id long, payload_bytes long, payload binary")


# --- writing ---------------------------------------------------------------------------------

def mark_revisits(pages: DataFrame, page_id: str = "page_id", html: str = "html",
                  least_bytes: int = LEAST_REVISIT_BYTES) -> DataFrame:
    """``pages`` with ``payload_bytes``, ``payload_digest``, ``record_type`` and ``refers_to``.

    Of equal payloads of ``least_bytes`` or more the largest page id is the response and the
    others revisit it; a null id counts as the smallest, and if all are null the rows are all
    responses. Repeated rows of the largest id are all responses. Shorter payloads, null ones
    included, are responses.
    """
    pages = without(pages, "payload_bytes", "payload_digest", "record_type", "refers_to")
    own_id, salt, keep = unused(pages, "id", "salt", "keep")
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = (pages.withColumn("payload_bytes", F.length(payload).cast("long"))
            .withColumn("payload_digest", F.sha1(payload))
            .withColumn(own_id, F.col(page_id).cast("long")))
    short, long = (rows.filter(F.col("payload_bytes") < least_bytes), rows.filter(F.col("payload_bytes") >= least_bytes))
    long = long.withColumn(salt, F.pmod(F.xxhash64(F.col(own_id)), F.lit(salts(pages.count()))))
    totals = salted_totals(long, "payload_digest", page_id, salt, (keep, F.max(own_id), F.max(keep)))
    revisit = F.col(keep).isNotNull() & ~F.col(own_id).eqNullSafe(F.col(keep))
    long = (long.join(totals, ["payload_digest", salt])
            .withColumn("record_type", F.when(revisit, "revisit").otherwise("response"))
            .withColumn("refers_to", F.when(revisit, F.col(keep))))
    short = short.withColumn("record_type", F.lit("response")).withColumn("refers_to", F.lit(None).cast("long"))
    results = columns(pages, "payload_bytes", "payload_digest", "record_type", "refers_to")
    return short.select(*results).unionByName(long.select(*results))


def write_warc(marked: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html",
               records_per_file: int = 20_000, compression: str = "gzip") -> None:
    """Write one record per row of :func:`mark_revisits` below ``folder``.

    A record is one row of Spark's text writer with the end of a WARC record as line separator,
    so a lost task's files are never seen. A response holds the HTML in UTF-8, a revisit an empty
    block, its page's digest and the id of the record it refers to. Header values lose line
    breaks; a null URL leaves its header out. ``WARC-Page-Length`` keeps the payload's bytes,
    which a revisit doesn't hold. Files are compressed as a whole unless ``compression`` is ``none``, with
    which payloads that aren't wanted need not even be read.
    """
    def header(name: str, value) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))

    def urn(value) -> Column:
        return F.concat(F.lit("<urn:page:"), value.cast("string"), F.lit(">"))

    body = F.when(F.col("record_type") == "revisit", "").otherwise(F.coalesce(F.col(html), F.lit("")))
    line = F.concat(
        F.lit(VERSION + "\r\n"),
        header("WARC-Type", F.col("record_type")),
        F.coalesce(header("WARC-Record-ID", urn(F.col(page_id))), F.lit("WARC-Record-ID: <urn:page:>\r\n")),
        header("WARC-Date", F.lit(CAPTURED)),
        F.coalesce(header("WARC-Target-URI", F.regexp_replace(F.col(url), r"[\r\n]+", " ")), F.lit("")),
        header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        header("WARC-Page-Length", F.col("payload_bytes").cast("string")),
        F.when(F.col("record_type") == "revisit",
               F.concat(header("WARC-Refers-To", urn(F.col("refers_to"))),
                        header("WARC-Profile", F.lit(REVISIT_PROFILE)))).otherwise(F.lit("")),
        F.lit("Content-Type: text/html; charset=utf-8\r\n"),
        header("Content-Length", F.octet_length(body).cast("string")),
        F.lit("\r\n"), body)
    (marked.select(line.alias("value")).write.option("lineSep", END).option("compression", compression)
     .option("maxRecordsPerFile", records_per_file).text(folder))


# --- reading ---------------------------------------------------------------------------------

@dataclass
class Files(InputPartition):
    """Files that one task reads in turn."""

    paths: tuple[str, ...]


def _fields(block: bytes) -> dict[str, str]:
    fields = {}
    for line in block.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            fields[name.strip().lower()] = value.strip()
    return fields


def records(stream: io.BufferedIOBase, wanted, with_payload: bool) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """Headers of each record that ``wanted`` accepts, and its block if asked for.

    The block of a record that isn't wanted, and any block when no payload is asked for, is
    passed over by its length without being copied or decoded. A record cut off by the file's
    end raises EOFError.
    """
    while True:
        line = stream.readline()
        while line == b"\r\n":
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not the start of a WARC record: {line[:40]!r}")
        head = bytearray(line)
        while (line := stream.readline()) not in (b"\r\n", b""):
            head += line
        fields = _fields(bytes(head))
        length = int(fields.get("content-length", "0"))
        if with_payload and wanted(fields):
            block = stream.read(length)
            if len(block) < length:
                raise EOFError("a WARC record ends before its length")
            yield fields, block
        else:
            if wanted(fields):
                yield fields, None
            _skip(stream, length)


def _skip(stream: io.BufferedIOBase, length: int) -> None:
    if stream.seekable():
        stream.seek(length, io.SEEK_CUR)
        return
    while length and (step := len(stream.read(min(length, 1 << 20)))):
        length -= step


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.with_payload = options.get("payload", "true").lower() == "true"
        self.bytes_per_task = int(options.get("bytespertask", 128 << 20))
        #: (header, accepted values, whether they are prefixes)
        self.tests: list[tuple[str, tuple[str, ...], bool]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Take equality, membership and prefix tests of header columns; leave others to Spark."""
        for f in filters:
            name = HEADERS.get(f.attribute[0]) if len(getattr(f, "attribute", ())) == 1 else None
            # The digest and the ids are columns in another form than their headers.
            if name in (None, "warc-payload-digest", "warc-refers-to") or isinstance(f, (IsNotNull, EqualNullSafe)):
                yield f
            elif isinstance(f, EqualTo):
                self.tests.append((name, (f.value,), False))
            elif isinstance(f, In):
                self.tests.append((name, tuple(f.value), False))
            elif isinstance(f, StringStartsWith):
                self.tests.append((name, (f.value,), True))
            else:
                yield f

    def partitions(self) -> list[Files]:
        groups, group, size = [], [], 0
        for path, length in data_files(self.path):
            if group and size + length > self.bytes_per_task:
                groups.append(Files(tuple(group)))
                group, size = [], 0
            group.append(path)
            size += length
        return [*groups, Files(tuple(group))] if group else []

    def wanted(self, fields: dict[str, str]) -> bool:
        for name, values, prefix in self.tests:
            value = fields.get(name)
            if value is None or not (value.startswith(values) if prefix else value in values):
                return False
        return True

    def read(self, partition: Files | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark's stand-in for no partitions
            return
        system, _ = file_system(self.path)
        rows: list[tuple] = []
        held = 0
        for path in partition.paths:
            with system.open_input_file(path) as raw:
                stream = gzip.open(raw) if path.endswith(".gz") else io.BufferedReader(_Raw(raw), 1 << 20)
                for fields, block in records(stream, self.wanted, self.with_payload):
                    rows.append(_row(fields, block))
                    held += len(block or b"")
                    if len(rows) >= 4096 or held >= 32 << 20:
                        yield _batch(rows)
                        rows, held = [], 0
        if rows:
            yield _batch(rows)


class _Raw(io.RawIOBase):
    """A seekable raw stream over a pyarrow file, so that skipped payloads aren't read."""

    def __init__(self, file):
        self.file = file

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        data = self.file.read(len(buffer))
        buffer[:len(data)] = data
        return len(data)

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        return self.file.seek(offset, whence)

    def tell(self) -> int:
        return self.file.tell()


def _page(urn: str | None) -> int | None:
    digits = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits.lstrip("-").isdigit() else None


def _row(fields: dict[str, str], block: bytes | None) -> tuple:
    length = fields.get("warc-page-length") or fields.get("content-length", "0")
    digest = fields.get("warc-payload-digest")
    return (*(fields.get(HEADERS[c]) for c in ("record_type", "record_id", "target_uri")),
            digest.partition(":")[2] if digest and ":" in digest else digest, fields.get("warc-refers-to"),
            _page(fields.get("warc-record-id")), int(length), block)


ARROW = pa.schema([(c, pa.string()) for c in HEADERS] + [("page_id", pa.int64()), ("payload_bytes", pa.int64()),
                                                       ("payload", pa.binary())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), ARROW)], schema=ARROW)


class WarcSource(DataSource):
    """``spark.read.format("warc")``: WARC files, plain or gzip, below a folder.

    Options: ``payload`` (true; false leaves blocks unread) and ``bytesPerTask`` (128 MB, files
    are packed into tasks up to it; a file isn't split, as a record's start can't be told from
    page text). Filters on record type, record id and URL are applied to headers before a block
    is read.
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader({k.lower(): v for k, v in self.options.items()})


def read_warc(spark: SparkSession, folder: str, payload: bool = True) -> DataFrame:
    """The records below ``folder``; an empty folder gives no rows."""
    # Spark refuses sources that take filters unless this is set.
    if spark.conf.get("spark.sql.python.filterPushdown.enabled", "false") != "true":
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(folder)


def archive(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``pages`` as WARC files and return the records read back from them."""
    spark = pages.sparkSession
    folder = folder or new_folder(spark, "warc")
    write_warc(mark_revisits(pages), folder)
    return read_warc(spark, folder)


def archived_pages(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Per page what its record says; the digest and length of responses are those of the payload read.

    A response whose payload doesn't match the digest in its header raises.
    """
    spark, folder = pages.sparkSession, folder or new_folder(pages.sparkSession, "warc")
    found = archive(pages, folder)
    payload = found.filter(F.col("record_type") == "response").withColumn("real", F.sha1("payload"))
    checked = F.when(F.col("real") == F.col("payload_digest"), F.col("real")).otherwise(
        F.raise_error(F.concat(F.lit("payload differs from its digest: "), F.col("record_id"))))
    responses = payload.select("page_id", F.length("payload").cast("long").alias("payload_bytes"),
                               checked.alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    revisits = read_warc(spark, folder, payload=False).filter(F.col("record_type") == "revisit").select(
        "page_id", "payload_bytes", "payload_digest", "record_type",
        F.regexp_extract("refers_to", r"<urn:page:(-?[0-9]+)>", 1).cast("long").alias("refers_to"))
    return responses.unionByName(revisits)
