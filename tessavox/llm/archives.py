"""Legacy archive converter: ARC files to WARC files, with revisits for repeated payloads.

An ARC file begins with a version block (``filedesc://`` line, a line with the version, a line with the
names of the fields); each record has one header line of these fields, the last being its declared length, then
so many bytes and a line break. Version 1 has five fields, version 2 ten. Nothing but the declared lengths
says where a record ends.

Files are written by Spark's text writer, whose line separator is the mark behind each record of the format, so they
go through Spark's commit protocol to any file system. A file holds FILE_BYTES at most, or a single larger record: records of
similar size share files. What is read is inflated as a stream, a record at a time.
"""

from __future__ import annotations

import gzip
import re
import uuid
from collections.abc import Callable, Iterator
from hashlib import sha256
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessavox.llm.common import pick, scratch, tidy, whole, written

#: Names of the header fields of both versions, in the order of the line.
ARC_FIELDS = {
    "1": ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    "2": ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
#: Payloads below this size are never made revisits.
MIN_REVISIT = 100
#: Bytes of a written file before compression, at most, but for single larger records; least and most bytes that the classes of
#: records of a like size go to (each class is up to SIZE_STEP times as large as the one before).
FILE_BYTES, SMALL_RECORD, SIZE_STEP = 128 << 20, 64 << 10, 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE_FIELD = "X-Page-Id"
_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the name space of URLs, RFC 9562


def _clean(url):
    """A URL without the characters that would break a header line; null and empty ones get a placeholder."""
    return F.coalesce(F.nullif(F.regexp_replace(url, r"[\x00-\x20\x7F]", "_"), F.lit("")), F.lit("unknown:"))


def write_arc(pages: DataFrame, path: str, version: str = "1", date: str = "20240101000000", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Pages as ARC records: an HTTP response whose body is the page in UTF-8 (null: empty).

    The page's id travels in an HTTP header. Each record's header line gives the length in bytes. A file begins
    with a version block for its records; ``date`` is the archive date of all records.
    """
    fields = ARC_FIELDS[version]
    about = f"{version} 0 tessavox\n{' '.join(fields)}\n"
    block = f"filedesc://pages.arc 0.0.0.0 {date} text/plain {len(about)}\n{about}"
    body = pick(pages, page=id_col, url=url_col, html=html_col).select("page", _clean(F.col("url")).alias("url"), whole("html").alias("html"))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("html").cast("string"), F.lit("\r\n"), F.coalesce(F.concat(F.lit(f"{PAGE_FIELD}: "), F.col("page").cast("string"), F.lit("\r\n")), F.lit("")), F.lit("\r\n"))
    rows = body.select("url", F.concat(head, F.col("html")).alias("content"), F.octet_length("html").alias("size"))
    middle = "" if version == "1" else "200 - - 0 pages.arc "
    line = F.concat(F.col("url"), F.lit(f" 0.0.0.0 {date} text/html {middle}"), F.octet_length("content").cast("string"), F.lit("\n"))
    # a version block may stand before any record; here before each partition's first and then at every file's worth
    at = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)

    def write(some: DataFrame, to: str, records: int) -> None:
        mark = F.when(at % records == 0, F.lit(block + "\n")).otherwise(F.lit(""))
        _write_text(some.select(F.concat(mark, line, F.col("content")).alias("value")), to, "\n", records)

    _by_size(rows, rows, path, write)


def _write_text(rows: DataFrame, path: str, mark: str, records: int) -> None:
    rows.write.option("lineSep", mark).option("compression", "gzip").option("maxRecordsPerFile", records).text(path)


def _by_size(rows: DataFrame, sizes_of: DataFrame, path: str, write: Callable[[DataFrame, str, int], None]) -> None:
    """Calls write(rows, folder, records of a file) for each class of sizes that occurs, so that no file passes FILE_BYTES.

    sizes_of has the sizes of all rows at least.
    """
    above = -1
    sizes = [SMALL_RECORD * SIZE_STEP**k for k in range(4)]  # the last one is beyond any string
    steps = F.array(*[F.lit(s) for s in sizes[:-1]])
    there = {r.k for r in sizes_of.select(F.size(F.filter(steps, lambda s: s < F.col("size"))).alias("k")).distinct().collect()} or {0}
    for k, most in enumerate(sizes):
        if k in there:
            write(rows.where((F.col("size") > above) & (F.col("size") <= most)), f"{path}/size{k}", max(1, FILE_BYTES // most))
        above = most


def arc_records(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and content of each record of an ARC file, version blocks left out.

    Raises ValueError where a line doesn't fit the version or a declared length runs beyond the file.
    """
    at, fields = 0, None
    while line := stream.readline():
        if line == b"\n":  # the mark behind a record; more than one is tolerated
            at += 1
            continue
        if not line.endswith(b"\n"):
            raise ValueError(f"no header line at byte {at}")
        parts = line[:-1].decode("utf-8", "replace").rstrip("\r").split(" ")
        if not parts[-1].isdigit():
            raise ValueError(f"no length in the header line at byte {at}")
        content = stream.read(int(parts[-1]))
        if len(content) < int(parts[-1]):
            raise ValueError(f"the record at byte {at} is cut off")
        if parts[0].startswith("filedesc:"):
            lines = content.decode().split("\n")
            fields = tuple(lines[1].split(" "))
            version = lines[0].split(" ")[0]
            if ARC_FIELDS.get(version) != fields:
                raise ValueError(f"unknown version block at byte {at}: {lines[:2]}")
        else:
            if fields is None or len(parts) != len(fields):
                raise ValueError(f"the header line at byte {at} doesn't fit the version")
            yield dict(zip(fields, parts, strict=True)), content
        at += len(line) + len(content)


def split_http(content: bytes) -> tuple[bytes, memoryview]:
    """Header block (with its blank line) and payload; without a blank line all is payload."""
    content = memoryview(content)
    head = bytes(content[: 1 << 16])
    end = head.find(b"\r\n\r\n") if head.startswith(b"HTTP/") else -1
    if end < 0 and head.startswith(b"HTTP/"):
        head = bytes(content)
        end = head.find(b"\r\n\r\n")
    return (head[: end + 4], content[end + 4 :]) if end >= 0 else (b"", content)


def http_page(head: bytes) -> int | None:
    found = re.search(rb"(?i)\r\n" + PAGE_FIELD.encode() + rb": (-?\d+)\r\n", head)
    return int(found[1]) if found else None


def warc_date(arc: str) -> str:
    """14 digits (shorter ones filled up) as a WARC timestamp."""
    d = (arc + "00000101000000"[len(arc) :])[:14] if len(arc) < 14 else arc[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(url: str, date: str, page: int | None, digest: str) -> str:
    """The same record always gets the same identifier."""
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'{url} {date} {page} {digest}')}>"


ARC_SCHEMA = "page_id long, url string, date string, mime string, ip string, head string, payload binary, size long, digest string, record_id string"


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0").select("path", "content")


def _unzipped(content: pa.Scalar) -> BinaryIO:
    """A file's bytes as a stream, inflated as it is read."""
    raw = pa.BufferReader(content.as_buffer())
    return gzip.GzipFile(fileobj=raw) if content.as_buffer()[:2].to_pybytes() == b"\x1f\x8b" else raw


def read_arc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row for each record of the ARC files (plain or gzip), with what its WARC record needs.

    payload is null when left out; size and digest are always of the whole payload.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), *[(n, pa.string()) for n in ("url", "date", "mime", "ip", "head")], ("payload", pa.binary()), ("size", pa.int64()), ("digest", pa.string()), ("record_id", pa.string())])

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

        for b in batches:
            for content in b.column(1):
                rows, held = [], 0
                for fields, body in arc_records(_unzipped(content)):
                    head, payload = split_http(body)
                    page, date, digest = http_page(head), warc_date(fields["Archive-date"]), sha256(payload).hexdigest()
                    rows.append((page, fields["URL"], date, fields["Content-type"], fields["IP-address"], head.decode("utf-8", "replace"), bytes(payload) if payloads else None, len(payload), digest, record_id(fields["URL"], date, page, digest)))
                    held += len(payload) if payloads else 500
                    if held > 8 << 20:
                        yield batch(rows)
                        rows, held = [], 0
                if rows:
                    yield batch(rows)

    return _files(spark, path).mapInArrow(run, ARC_SCHEMA)


def first_pages(records: DataFrame) -> DataFrame:
    """digest, first (smallest page id), first_record of the payloads that may be revisited and stand in several records."""
    least = F.min(F.struct(F.col("page_id").alias("page"), F.col("record_id").alias("record")))
    many = records.where((F.col("size") >= MIN_REVISIT) & F.col("page_id").isNotNull()).groupBy("digest").agg(least.alias("first"), F.count("*").alias("n")).where("n > 1")
    return many.select("digest", F.col("first.page").alias("first"), F.col("first.record").alias("first_record"))


def convert(spark: SparkSession, arc_path: str, warc_path: str) -> None:
    """ARC files to WARC files.

    Of equal payloads of at least MIN_REVISIT bytes the one with the smallest page id stays a response, the others
    become revisits without the payload. First the digests alone are gathered (counts and minima by digest, a hot one
    adds up before it moves), then the records take their type from the result.
    """
    meta = written(read_arc(spark, arc_path, payloads=False).select("page_id", "size", "digest", "record_id"), "digests")
    first = written(first_pages(meta), "firsts")
    # narrow rows: each revisit's own identifier and what it refers to
    revisits = written(meta.join(first, "digest").where((F.col("size") >= MIN_REVISIT) & (F.col("page_id") != F.col("first"))).select(F.col("record_id").alias("rid"), "first", "first_record").distinct(), "revisits")
    rows = read_arc(spark, arc_path).withColumn("payload", F.col("payload").cast("string"))
    typed = rows.join(revisits, rows.record_id == revisits.rid, "left").withColumn("again", F.col("first").isNotNull())
    field = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    block = F.when(F.col("again"), F.col("head")).otherwise(F.concat("head", "payload"))
    http = F.col("head") != ""
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        field("WARC-Type", F.when(F.col("again"), "revisit").otherwise(F.lit("response"))),
        field("WARC-Record-ID", F.col("record_id")),
        field("WARC-Date", F.col("date")),
        field("WARC-Target-URI", F.col("url")),
        field("WARC-IP-Address", F.col("ip")),
        field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        F.when(F.col("again"), F.concat(field("WARC-Profile", F.lit(PROFILE)), field("WARC-Refers-To", F.col("first_record")), field("Refers-To-Page-Id", F.col("first").cast("string")))).otherwise(F.lit("")),
        field("Payload-Length", F.col("size").cast("string")),
        field("Content-Type", F.when(http, F.lit("application/http; msgtype=response")).otherwise(F.col("mime"))),
        field("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
    )
    stored = F.when(F.col("again"), F.lit(0)).otherwise(F.col("size"))
    records = typed.select(F.concat(head, block).alias("value"), stored.alias("size"))
    _by_size(records, meta.select("size").union(spark.range(1).select(F.lit(0).cast("long"))), warc_path, lambda some, to, n: _write_text(some.select("value"), to, "\r\n\r\n", n))


def warc_records(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Named fields (lower case) and block of each record of a WARC file, by the declared lengths."""
    while line := stream.readline():
        if line == b"\r\n":
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record in {line[:80]!r}")
        fields = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            k, _, v = line.decode().partition(":")
            fields[k.strip().lower()] = v.strip()
        block = stream.read(int(fields["content-length"]))
        if len(block) < int(fields["content-length"]):
            raise ValueError("the last record is cut off")
        yield fields, block


WARC_SCHEMA = "page_id long, url string, date string, record_id string, record_type string, refers_to long, refers_to_record string, payload_bytes long, payload_digest string, payload binary"


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row for each record. A response's size and digest are taken from its payload, a revisit's from its fields."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), *[pa.string()] * 4, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        names = [x.split(" ")[0] for x in WARC_SCHEMA.split(", ")]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for b in batches:
            for content in b.column(1):
                rows, held = [], 0
                for f, block in warc_records(_unzipped(content)):
                    head, payload = split_http(block)
                    again = f["warc-type"] == "revisit"
                    size = int(f["payload-length"]) if again else len(payload)
                    digest = f["warc-payload-digest"].removeprefix("sha256:") if again else sha256(payload).hexdigest()
                    to = f.get("refers-to-page-id")
                    rows.append((http_page(head), f.get("warc-target-uri"), f["warc-date"], f["warc-record-id"], f["warc-type"], int(to) if to else None, f.get("warc-refers-to"), size, digest, bytes(payload) if payloads and not again else None))
                    held += len(payload) if payloads else 500
                    if held > 8 << 20:
                        yield batch(rows)
                        rows, held = [], 0
                if rows:
                    yield batch(rows)

    return _files(spark, path).mapInArrow(run, WARC_SCHEMA)


def archived(pages: DataFrame, version: str = "1", payloads: bool = True, **columns: str) -> DataFrame:
    """Pages to ARC, ARC to WARC, and the WARC files' records.

    Null pages are empty payloads, null URLs get a placeholder. Rows without an id are always responses;
    rows that repeat an id with the same page are each written, and keep the type of that id. An empty table gives no record.
    Extra columns are ignored.
    """
    spark = pages.sparkSession
    with tidy(spark):
        arc, warc = scratch(spark, "arc"), scratch(spark, "warc", last=True)
        write_arc(pages, arc, version, **columns)
        convert(spark, arc, warc)
    return read_warc(spark, warc, payloads)
