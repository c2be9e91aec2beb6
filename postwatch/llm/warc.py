"""WARC archives: a writer that stores equal payloads once, and a sequential reader."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postwatch.llm.common import materialize, spread_join, table, text_or_empty
from postwatch.session import scratch_path

#: Payloads of fewer bytes are never stored as revisits.
MIN_REVISIT = 1000
#: Bytes of records after which a task starts its next archive.
ARCHIVE_BYTES = 256 << 20
#: Compressed bytes the reader takes at a time.
READ_BYTES = 1 << 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
WRITTEN = "path string, records long"
RECORDS = ("path string, record_type string, page_id long, uri string, refers_to long, "
           "payload binary, payload_bytes long, payload_digest string, verified boolean")


class ArchiveError(ValueError):
    """An archive that breaks the format: bad framing, a cut member or a wrong digest."""


def sha1_label(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_name(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(name: str | None) -> int | None:
    number = (name or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def header_value(text: str | None) -> str:
    """A header's value on one line."""
    return "".join(c if c.isprintable() else "%%%02X" % ord(c) for c in text or "")


def record(page_id: int | None, uri: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One gzip member.  A revisit has the HTTP header of its payload, length included, and no
    payload; its digest is that of the whole payload."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_name(page_id)}", f"WARC-Target-URI: {header_value(uri)}",
        "WARC-Date: 1970-01-01T00:00:00Z", "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: {sha1_label(payload)}", f"WARC-Block-Digest: {sha1_label(block)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {record_name(refers_to)}", f"WARC-Profile: {PROFILE}"]
    lines.append(f"Content-Length: {len(block)}")
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    head = ("\r\n".join(lines) + "\r\n\r\n").encode()
    return pack.compress(head + block + b"\r\n\r\n") + pack.flush()


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes
    verified: bool

    @property
    def http(self) -> tuple[dict[str, str], bytes]:
        head, _, body = self.block.partition(b"\r\n\r\n")
        return parsed(head), body


def parsed(head: bytes) -> dict[str, str]:
    """Headers by lower-case name; the first line is left out."""
    pairs = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def members(stream, size: int = READ_BYTES) -> Iterator[bytes]:
    """Contents of the gzip members of a stream, one after the other, decompressed bit by bit."""
    data, rest = bytearray(), b""
    unpack = zlib.decompressobj(31)
    begun = False
    while chunk := rest or stream.read(size):
        begun = True
        try:
            data += unpack.decompress(chunk)
        except zlib.error as error:
            raise ArchiveError(str(error)) from error
        rest = unpack.unused_data
        if unpack.eof:
            yield bytes(data)
            data, unpack, begun = bytearray(), zlib.decompressobj(31), False
    if begun:
        raise ArchiveError("the last member is cut")


def read_records(stream) -> Iterator[Record]:
    """Records of a WARC stream with one gzip member each.  The block is framed by the record's
    Content-Length and its digest is verified."""
    for data in members(stream):
        head, found, rest = data.partition(b"\r\n\r\n")
        headers = parsed(head)
        if not found or not head.startswith(b"WARC/") or "content-length" not in headers:
            raise ArchiveError("no record header")
        size = int(headers["content-length"])
        block, tail = rest[:size], rest[size:]
        if len(block) != size or tail != b"\r\n\r\n":
            raise ArchiveError("the block is not as long as its header says")
        yield Record(headers, block,
                     headers.get("warc-block-digest") in (None, sha1_label(block)))


def filesystem(path: str):
    """pyarrow's file system of a path and the path there: local, hdfs, s3, gs."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def _writer(folder: str, archive_bytes: int):
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each attempt of a task names its own files; only those of the attempt that Spark keeps
        get into the list of archives."""
        files, root = filesystem(folder)
        files.create_dir(root, recursive=True)
        out, done, size, count, name = None, [], 0, 0, ""
        for batch in batches:
            for row in batch.itertuples(index=False):
                if out is None:
                    name, size, count = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = files.open_output_stream(f"{root}/{name}", compression=None)
                data = record(_number(row.page_id), row.uri, bytes(row.payload),
                              _number(row.refers_to))
                out.write(data)
                size, count = size + len(data), count + 1
                if size >= archive_bytes:
                    out.close()
                    out, done = None, [*done, (f"{folder}/{name}", count)]
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", count))
        yield pd.DataFrame(done, columns=["path", "records"])

    return write


def _number(value) -> int | None:
    return None if pd.isna(value) else int(value)


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url",
                   html: str = "html", min_revisit: int = MIN_REVISIT,
                   archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record per row of pages into .warc.gz files in folder (a path that all executors
    reach) and return the written table of archives: path, records.

    Of equal payloads of at least min_revisit bytes, the one with the largest page_id is a
    response and the others revisit it; smaller ones are all responses.  Payloads are told apart by
    their length and two digests.  Only digests are gathered by payload, and a payload with very
    many copies is dealt over parts.

    A null html is an empty payload.  A null page_id never answers for others unless all are null;
    then all are responses.  Repeated rows of the largest page_id are all responses.  Line ends in
    urls are escaped.  Other columns are ignored; no rows give no archives.
    """
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("uri"),
                        text_or_empty(html).cast("binary").alias("payload"))
    digest = [F.length("payload").cast("long").alias("size"), F.sha2("payload", 256).alias("sha2"),
              F.sha1("payload").alias("sha1")]
    key = ["size", "sha2", "sha1"]
    narrow = materialize(rows.select("page_id", *digest).where(F.col("size") >= min_revisit),
                         "warc-digests")
    shared = narrow.groupBy(*key).agg(F.max("page_id").alias("refers_to"),
                                      F.count("*").alias("copies")).where("copies > 1")
    revisits = (spread_join(narrow, shared.drop("copies"), key, ["page_id"])
                .where("page_id IS NULL OR page_id <> refers_to")
                .select("page_id", "size", "sha2", "sha1", "refers_to").distinct())
    placed = rows.select("*", *digest).alias("r").join(
        materialize(revisits, "warc-revisits").alias("v"),
        F.col("r.page_id").eqNullSafe(F.col("v.page_id"))
        & (F.col("r.size") == F.col("v.size")) & (F.col("r.sha2") == F.col("v.sha2"))
        & (F.col("r.sha1") == F.col("v.sha1")), "left")
    out = placed.select("r.page_id", "r.uri", "r.payload", "v.refers_to")
    return materialize(out.mapInPandas(_writer(folder, archive_bytes), WRITTEN), "warc-archives")


def _reader(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in RECORDS.split(", ")]
    for batch in batches:
        for path in batch["path"]:
            files, at = filesystem(path)
            rows: list[tuple] = []
            held = 0
            with files.open_input_stream(at, compression=None) as stream:
                for found in read_records(stream):
                    rows.append((path, *_fields(found)))
                    held += len(found.block)
                    if held > 4 << 20:
                        yield _typed(rows, names)
                        rows, held = [], 0
            yield _typed(rows, names)


def _fields(found: Record) -> tuple:
    kind, http, payload = found.headers["warc-type"], *found.http
    label = found.headers.get("warc-payload-digest", "")
    stated = base64.b32decode(label.removeprefix("sha1:")).hex() if label else None
    page = page_of(found.headers.get("warc-record-id"))
    uri = found.headers.get("warc-target-uri")
    if kind == "revisit":
        return (kind, page, uri, page_of(found.headers.get("warc-refers-to")), None,
                int(http["content-length"]), stated, found.verified)
    digest = hashlib.sha1(payload).hexdigest()
    good = found.verified and stated in (None, digest) and len(payload) == int(
        http["content-length"])
    return kind, page, uri, None, payload, len(payload), digest, good


def _typed(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    kinds = {"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "Int64"}
    return pd.DataFrame(rows, columns=names).astype(kinds)


def read_archives(archives: DataFrame) -> DataFrame:
    """Records of the archives in column path, each read in order by one task: record_type,
    page_id, uri, refers_to, payload (null for revisits), payload_bytes and payload_digest (hex
    SHA-1, both of the full payload), verified.  A broken archive raises ArchiveError."""
    parts = archives.sparkSession.sparkContext.defaultParallelism
    spread = archives.select("path").distinct().repartition(parts, "path")
    return spread.mapInPandas(_reader, RECORDS)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages", "page_id", "url", "html")
    archives = write_archives(pages, scratch_path(spark, "warc"))
    return read_archives(archives).select("page_id", "payload_bytes", "payload_digest",
                                          "record_type", "refers_to", "verified")


OP1_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages),
w AS (SELECT *, max(page_id) OVER (PARTITION BY n, h) AS last FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, h AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> last THEN last END AS refers_to, true AS verified
FROM w
"""
