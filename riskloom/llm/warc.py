"""Content-addressed WARC archive: payloads once, headers apart, records by join."""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.scratch import drop_path, new_path, shuffles_dropped

#: Fixed values of the format.
VERSION, EOL = "WARC/1.1", "\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of a gzip member at most, so that the last byte of its length is 0.
_MEMBER = (1 << 24) - 1


def _pack(payload: str) -> Column:
    """Payloads under zstd, so that stores and shuffles move few bytes."""

    @F.arrow_udf("binary")
    def run(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        packer = zstandard.ZstdCompressor(level=3)
        for column in it:
            yield pa.array([packer.compress(x.as_buffer()) for x in column], pa.binary())

    return run(payload)


def _unpack(packed: str) -> Column:
    @F.arrow_udf("binary")
    def run(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        unpacker = zstandard.ZstdDecompressor()
        for column in it:
            yield pa.array([unpacker.decompress(x.as_buffer()) for x in column], pa.binary())

    return run(packed)


@dataclass(frozen=True)
class Archive:
    """Folders of an archive: payload bytes once a digest, and headers of every record."""

    payloads: str
    headers: str


def _record_id(page_id: Column) -> Column:
    """A stable urn for a page; only its hash, so no state is needed."""
    h = F.sha1(F.concat(F.lit("riskloom:"), F.coalesce(page_id.cast("string"), F.lit(""))))
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-8"), F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


def write_archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 1000, date: str = "2024-01-01T00:00:00Z") -> Archive:
    """Store every page: its payload once for each SHA-256, its exact header block apart.

    Payloads are the text in UTF-8, empty for null. Of equal payloads of at
    least `least` bytes the row with the largest id is the response and the
    others revisit it; smaller ones are responses all. Rows that repeat the
    largest id are responses too, and a null id is below all others. Null urls
    have an empty target; a url that no header line can hold as it is also
    stands in Base64 beside its escaped form, so it comes back unchanged. `date`
    is every record's, as pages have none. Equal payloads are found by digest
    alone, through partial aggregation and a join, so a frequent page is no
    group in one task.
    """
    spark = pages.sparkSession
    payload = F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    archive = Archive(new_path(spark, "payloads"), new_path(spark, "headers"))
    stored = rows.select("digest", "page_id", _pack("payload").alias("packed")).groupBy("digest").agg(F.max("page_id").alias("holder"), F.any_value("packed").alias("packed"))
    with shuffles_dropped(spark):
        stored.write.parquet(archive.payloads)
    holders = spark.read.schema("digest string, holder long").parquet(archive.payloads)
    lean = rows.select("page_id", "url", "digest", F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("size"))
    placed = lean.join(holders, "digest")
    revisit = (F.col("size") >= least) & ~F.col("page_id").eqNullSafe(F.col("holder"))
    escaped = F.regexp_replace("url", "[\\x00-\\x20\\x7F]", "%20")
    fields = [
        ("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        ("WARC-Record-ID", _record_id(F.col("page_id"))),
        ("WARC-Date", F.lit(date)),
        ("WARC-Target-URI", escaped),
        ("X-Target-URI-Base64", F.when(escaped != F.col("url"), F.translate(F.base64(F.encode("url", "UTF-8")), EOL, ""))),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        ("X-Payload-SHA256", F.col("digest")),
        ("X-Payload-Length", F.col("size").cast("string")),
        ("X-Page-ID", F.col("page_id").cast("string")),
        ("WARC-Profile", F.when(revisit, REVISIT_PROFILE)),
        ("WARC-Refers-To", F.when(revisit, _record_id(F.col("holder")))),
        ("X-Refers-To-Page", F.when(revisit, F.col("holder").cast("string"))),
        ("Content-Type", F.lit("text/html; charset=utf-8")),
        ("Content-Length", F.when(revisit, "0").otherwise(F.col("size").cast("string"))),
    ]
    lines = [F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), v)) for k, v in fields]
    header = F.concat(F.concat_ws(EOL, F.lit(VERSION), *lines), F.lit(EOL + EOL))
    with shuffles_dropped(spark):
        placed.select(F.when(~revisit, F.col("digest")).alias("digest"), header.alias("header")).write.option("compression", "zstd").parquet(archive.headers)
    return archive


def read_records(spark: SparkSession, archive: Archive) -> DataFrame:
    """header and payload of every original record; a revisit's payload is empty."""
    headers = spark.read.schema("digest string, header string").parquet(archive.headers)
    payloads = spark.read.schema("digest string, packed binary").parquet(archive.payloads)
    carrying = headers.filter("digest is not null").join(payloads, "digest").select("header", _unpack("packed").alias("payload"))
    return carrying.unionByName(headers.filter("digest is null").select("header", F.lit(b"").alias("payload")))


def _members(record: bytes) -> Iterator[bytes]:
    """A record as gzip members: one, but for records of 16 MB and more."""
    for at in range(0, len(record), _MEMBER):
        yield gzip.compress(record[at : at + _MEMBER], 6, mtime=0)


def export_warc(records: DataFrame, target_bytes: int = 32 << 20) -> str:
    """Write records as WARC files, a gzip member a record, and return their folder.

    A record is header, payload and two line ends. A file is closed by the
    record with which it reaches target_bytes, compressed, so readers can seek to
    any member and hold any file. Spark's text writer puts a file's bytes out as
    they are, as one line; the end of the line is the NUL byte in which the
    length at a member's end ends.
    """
    spark = records.sparkSession
    path = new_path(spark, "warc")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in it:
            for header, payload in zip(batch["header"], batch["payload"], strict=True):
                for member in _members(header.as_py().encode() + payload.as_py() + (EOL + EOL).encode()):
                    held.append(member)
                    size += len(member)
                if size >= target_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], ["file"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], ["file"])

    files = records.select("header", "payload").mapInArrow(run, "file binary")
    with shuffles_dropped(spark):
        files.select(F.col("file").cast("string").alias("value")).write.option("lineSep", "\0").option("compression", "none").option("maxRecordsPerFile", 1).text(path)
    return path


def unpacked(data: bytes) -> Iterator[bytes]:
    """The records of a file of gzip members, those that several members hold in one; small pieces go in, so each byte is copied a few times at most."""
    at, parts = 0, []
    while at < len(data):
        member, out = zlib.decompressobj(31), []
        while not member.eof:
            if at >= len(data):
                raise ValueError("the file ends inside a gzip member")
            piece = data[at : at + (16 << 10)]
            out.append(member.decompress(piece))
            at += len(piece)
        at -= len(member.unused_data)
        parts.append(b"".join(out))
        if len(parts[-1]) < _MEMBER:
            yield b"".join(parts)
            parts = []
    if parts:
        yield b"".join(parts)


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record of an uncompressed WARC file; faults raise."""
    at, end = 0, EOL.encode()
    while at < len(data):
        stop = data.find(end + end, at)
        if stop < 0 or not data.startswith(VERSION.encode() + end, at):
            raise ValueError(f"no record at byte {at}")
        lines = data[at:stop].decode().split(EOL)[1:]
        fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
        start = stop + 4
        after = start + int(fields["Content-Length"])
        if data[after : after + 4] != end + end:
            raise ValueError(f"the record at byte {at} does not end where its length says")
        yield fields, data[start:after]
        at = after + 4


READ = "page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long, url string, digest string, header_only boolean"


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Parse gzipped WARC files; each payload is checked against its length and both digests."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("content")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for content in batch["content"]:
                out: list[tuple] = []
                for f, block in (x for record in unpacked(content.as_py()) for x in parse_warc(record)):
                    kind, sha1 = f["WARC-Type"], f["WARC-Payload-Digest"].removeprefix("sha1:")
                    size = int(f["X-Payload-Length"])
                    if kind == "response" and (len(block) != size or hashlib.sha1(block).hexdigest() != sha1 or hashlib.sha256(block).hexdigest() != f["X-Payload-SHA256"]):
                        raise ValueError(f"payload of {f['WARC-Record-ID']} does not match its digests")
                    url = base64.b64decode(f["X-Target-URI-Base64"]).decode() if "X-Target-URI-Base64" in f else f["WARC-Target-URI"]
                    out.append((int(f["X-Page-ID"]) if "X-Page-ID" in f else None, kind, size, sha1, int(f["X-Refers-To-Page"]) if kind == "revisit" else None, url, f["X-Payload-SHA256"], kind == "revisit"))
                names = [x.split(" ")[0] for x in READ.split(", ")]
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 8, kinds, strict=True)], names)

    return files.mapInArrow(run, READ)


def op6_warc(spark, sf_dir: str) -> DataFrame:
    """Every page written as a WARC record and read back."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    archive = write_archive(pages)
    folder = export_warc(read_records(spark, archive))
    for stored in (archive.payloads, archive.headers):
        drop_path(spark, stored)
    return read_warc(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS payload_digest, max(page_id) OVER (PARTITION BY sha256(b)) AS holder FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> holder THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> holder THEN holder END AS refers_to
FROM d
"""
