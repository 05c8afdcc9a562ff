"""WARC archives: a writer of one gzip member per record and a sequential reader.

Archives are written by Spark's own text writer as raw bytes, so they land in
any store Spark can write. Its line separator is an empty gzip member, which
keeps every archive a valid multi-member gzip file. The reader opens an archive
as a stream and goes through it record by record: incremental decompression,
content-length framing, digest verification. It holds one record at a time and
reads any archive of gzip members or plain records, whatever their types.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import zlib
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, in_arrow, join_evenly, stored, table

LEAST_REVISIT = 100
EMPTY_MEMBER = gzip.compress(b"", mtime=0).decode("latin-1")
STEP = 1 << 16
MOST_HEADER = 1 << 20  # bytes of a record's header
OUT = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("ok", pa.bool_()), ("record_id", pa.string())]
)
OUT_DDL = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, ok boolean, record_id string"


class WarcError(ValueError):
    """An archive that breaks the framing: cut short, without a header end, or with a wrong length."""


def member(page: int | None, url: str | None, kind: str, size: int, digest: str, refers: int | None, body: bytes, level: int = 6) -> bytes:
    """A record as one gzip member. A revisit has no body but names the full payload's digest and size."""
    uri = "".join(c if c > " " else f"%{ord(c):02X}" for c in (url or ""))
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page is None else page}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(body).hexdigest()}", f"X-Payload-Length: {size}",
    ]
    if url is None:
        head[4] = "X-No-Target-URI: 1"
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers}>"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + squeeze.flush()


class Unzipped:
    """The plain bytes of an archive, read forward: gzip members one after the other, or an archive that is not compressed."""

    def __init__(self, raw: BinaryIO):
        self.raw, self.held, self.rest, self.unzip = raw, bytearray(), b"", None
        self.rest = raw.read(STEP)
        self.plain = not self.rest.startswith(b"\x1f\x8b")

    def _more(self) -> bool:
        """Add some bytes to what is held; False at the end. Raises WarcError where a member is cut short or damaged."""
        piece = self.rest or self.raw.read(STEP)
        self.rest = b""
        if not piece:
            if self.unzip is not None:
                raise WarcError("the archive ends within a member")
            return False
        if self.plain:
            self.held += piece
            return True
        self.unzip = self.unzip or zlib.decompressobj(31)
        try:
            self.held += self.unzip.decompress(piece, 16 * STEP)
        except zlib.error as e:
            raise WarcError(f"damaged member: {e}") from e
        if self.unzip.eof:
            self.rest, self.unzip = self.unzip.unused_data, None
        else:
            self.rest = self.unzip.unconsumed_tail
        return True

    def take(self, n: int) -> bytes:
        """The next n bytes, fewer at the end."""
        while len(self.held) < n and self._more():
            pass
        out = bytes(self.held[:n])
        del self.held[:n]
        return out

    def until(self, end: bytes, most: int) -> bytes | None:
        """All up to and with the next `end`; None if the archive ends before anything."""
        at = 0
        while (found := self.held.find(end, at)) < 0:
            at = max(0, len(self.held) - len(end) + 1)
            if len(self.held) > most:
                raise WarcError("no record header")
            if not self._more():
                if self.held:
                    raise WarcError("no record header")
                return None
        return self.take(found + len(end))

    def skip_lines(self) -> None:
        """Past the empty lines that end a record."""
        while True:
            if not self.held and not self._more():
                return
            n = len(self.held) - len(self.held.lstrip(b"\r\n"))
            del self.held[:n]
            if self.held:
                return


def holds(header: str | None, data: bytes) -> bool:
    """Whether a digest header (sha1, sha256 or md5, as hex or base32) is that of the data; True without one or with another kind."""
    kind, _, value = (header or "").partition(":")
    if kind.lower().replace("-", "") not in ("sha1", "sha256", "md5") or not value:
        return True
    own = hashlib.new(kind.lower().replace("-", ""), data)
    return value.strip().lower() in (own.hexdigest(), base64.b32encode(own.digest()).decode().lower().rstrip("="), base64.b32encode(own.digest()).decode().lower())


def read_headers(stream: Unzipped) -> dict[str, str] | None:
    """The headers of the next record by lower-case name; None at the end of the archive."""
    stream.skip_lines()
    head = stream.until(b"\r\n\r\n", MOST_HEADER)
    if head is None:
        return None
    if not head.startswith(b"WARC/"):
        raise WarcError("no record header")
    out: dict[str, str] = {}
    name = ""
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()  # a folded line
        elif ":" in line:
            name = line.partition(":")[0].strip().lower()
            out[name] = line.partition(":")[2].strip()
    if not out.get("content-length", "").isdigit():
        raise WarcError("no content length")
    return out


def _page(uri: str | None) -> int | None:
    """The number of a <urn:page:...> that this module writes; None for any other id."""
    number = (uri or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if (uri or "").startswith("<urn:page:") and number.lstrip("-").isdigit() else None


def read_records(archive: BinaryIO | bytes) -> Iterator[tuple]:
    """Rows (page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload, ok, record_id) of an archive.

    The payload is the record's block, of an HTTP message what follows its
    header; payload_digest and payload_bytes are those of the full payload,
    which for a revisit its headers name. ok tells that the block and payload
    digests hold, as far as the record has them.
    """
    stream = Unzipped(io.BytesIO(archive) if isinstance(archive, bytes) else archive)
    while (head := read_headers(stream)) is not None:
        size, kind = int(head["content-length"]), head.get("warc-type", "")
        block = stream.take(size)
        if len(block) != size or stream.take(4) != b"\r\n\r\n":
            raise WarcError("the content length does not frame the block")
        payload = block
        if head.get("content-type", "").lower().startswith("application/http"):
            payload = block.partition(b"\r\n\r\n")[2]
        named, revisit = head.get("warc-payload-digest"), kind == "revisit"
        ok = holds(head.get("warc-block-digest"), block) and (revisit or holds(named, payload))
        full = int(head["x-payload-length"]) if head.get("x-payload-length", "").isdigit() else len(payload)
        if not revisit:
            ok, full = ok and full == len(payload), len(payload)
        digest = named.partition(":")[2] if revisit and named else hashlib.sha256(payload).hexdigest()
        yield _page(head.get("warc-record-id")), head.get("warc-target-uri"), full, digest, kind, _page(head.get("warc-refers-to")), payload, ok, head.get("warc-record-id")


def write_warc(pages: DataFrame, path: str, level: int = 6) -> None:
    """Write a record for each row of pages (page_id, url, html) into archives under path.

    A null html is an empty payload. Of equal payloads of at least 100 bytes
    the smallest page_id is the response, and rows with other ids revisit it;
    null ids and rows that repeat the smallest id are responses. Every row
    gives a record, whose id is made of the page_id, so it is unique where the
    page_id is; an empty table gives archives without records.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("body")).withColumn("digest", F.sha2("body", 256))
    shared = stored(pages.sparkSession, rows.where(F.length("body") >= LEAST_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("_n")).where("_n > 1"), "shared")
    marked = join_evenly(rows, shared, "digest", "_n", ["page_id", "url"]).select("page_id", "url", "body", "digest", F.when(F.col("page_id") > F.col("first"), F.col("first")).alias("refers"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held = [], 0
            for page, url, body, digest, refers in zip(*(c.to_pylist() for c in batch.columns)):
                kind = "response" if refers is None else "revisit"
                out.append(member(page, url, kind, len(body), digest, refers, body if refers is None else b"", level))
                held += len(out[-1])
                if held > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["member"])
                    out, held = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["member"])

    # The cast keeps the bytes as they are, and the text writer writes them unchanged.
    marked.transform(in_arrow, run, "member binary").select(F.col("member").cast("string").alias("value")).write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER).text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives under path, as read_records gives them.

    Where the store of the path is one that a worker can open itself (a shared
    folder, S3, GCS, HDFS), a task gets the archives' names and streams them,
    however large. From other stores Spark hands over whole archives, which
    must then be under 2 GiB each.
    """
    try:
        fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else f"file:{path}")
        streams = True
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        streams = False

    def opened(value) -> BinaryIO:
        if not streams:
            return io.BytesIO(value)
        if value.startswith("file:"):
            store, name = fs.LocalFileSystem(), "/" + value.removeprefix("file:").lstrip("/")
        else:
            store, name = fs.FileSystem.from_uri(quote(value, safe="/:@?=&%"))
        return store.open_input_stream(name, compression=None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column(0).to_pylist():
                rows, held = [], 0
                with opened(value) as archive:
                    for r in read_records(archive):
                        rows.append(r)
                        held += len(r[6])
                        if held > 4 << 20:
                            yield _rows(rows)
                            rows, held = [], 0
                if rows:
                    yield _rows(rows)

    return spark.read.format("binaryFile").load(path).select("path" if streams else "content").transform(in_arrow, run, OUT_DDL)


def _rows(rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), OUT)], schema=OUT)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    back = read_warc(spark, path)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", F.col("ok").alias("verified"))


OP5_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to,
       true AS verified
FROM m
"""
