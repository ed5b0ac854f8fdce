"""WARC files: one gzip member per record, written and read in sequence.

The writer digests payloads, turns records whose payload an earlier page already has into revisits, and writes one member per record. Files are written and read by Spark, so any store that Spark
knows will do, and only the files of tasks that succeed are committed. The reader goes through a file block by block: incremental zlib decompression, records framed by their content length,
payload and block digests verified.

Spark's text sink ends each row with a separator. A gzip member ends with the high byte of its size, which is 0 for records under 16 MiB: that byte is the separator. A larger record is
followed by an empty member, which ends with 0 too; readers of gzip pass over it.

Rows: a null payload counts as empty; a null url is written as urn:x-page:<id>; a null page_id is written without one and sorts last. Of repeated rows
with the smallest page_id of their payload all are responses. Very long payloads are one record each. An empty table gives no files
and no rows. Other columns of the input are ignored."""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.llm.common import bounded_batches, dealt, fresh_path, read, stored

#: Records of a file (a reading task holds a file's compressed bytes), and bytes that the reader decompresses at a time.
PER_FILE, BLOCK = 8192, 64 << 10

# Names and forms of the WARC 1.1 format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record, not yet compressed."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": record_id(page_id),
        "WARC-Date": DATE,
        "WARC-Target-URI": quote(url, safe="".join(map(chr, range(33, 127)))) if url else f"urn:x-page:{page_id}",
        "WARC-Payload-Digest": "sha1:" + base32(hashlib.sha1(payload).digest()),
        "WARC-Block-Digest": "sha1:" + base32(hashlib.sha1(block).digest()),
        "Content-Type": "application/http;msgtype=response",
        "Content-Length": str(len(block)),
    }
    if page_id is not None:
        head["X-Page-Id"] = str(page_id)
    if revisit:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(refers_to), "X-Refers-To-Page-Id": str(refers_to)}
    return b"".join([VERSION, b"\r\n", *(f"{k}: {v}\r\n".encode() for k, v in head.items()), b"\r\n", block, b"\r\n\r\n"])


def member(data: bytes) -> bytes:
    """A gzip member that ends with a 0 byte; for 16 MiB and more, with an empty member behind it."""
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    out = squeeze.compress(data) + squeeze.flush()
    return out if out[-1] == 0 else out + member(b"")


class Members:
    """The decompressed bytes of a file of gzip members, in sequence; a record may not cross members."""

    def __init__(self, source):
        self._source, self._rest, self._member, self._ready, self.ended = source, b"", None, bytearray(), False

    def _more(self) -> bool:
        """Decompresses one more block of the member; false at its end."""
        if self._member is None:
            return False
        if not self._rest:
            self._rest = self._source.read(BLOCK)
            if not self._rest:
                raise ValueError("the file ends inside a gzip member")
        self._ready += self._member.decompress(self._rest, BLOCK)
        self._rest = self._member.unconsumed_tail or self._member.unused_data
        if self._member.eof:
            self._member = None
        return True

    def begin(self) -> bool:
        """Goes to the next member, if there is one."""
        if self._member is not None or self._ready:
            raise ValueError("bytes are left in the gzip member")
        self._rest = self._rest or self._source.read(BLOCK)
        if not self._rest:
            return False
        self._member = zlib.decompressobj(31)
        while not self._ready and self._more():
            pass
        return True if self._ready else self.begin()  # an empty member holds no record

    def until(self, mark: bytes) -> bytes:
        while (at := self._ready.find(mark)) < 0:
            if not self._more():
                raise ValueError("the gzip member ends inside a header")
        out = bytes(self._ready[:at])
        del self._ready[: at + len(mark)]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        """The next n bytes, in pieces."""
        while n:
            if not self._ready and not self._more():
                raise ValueError("the gzip member ends inside a block")
            piece = bytes(self._ready[:n])
            del self._ready[:n]
            n -= len(piece)
            if piece:
                yield piece

    def end(self) -> None:
        """Reads what trails the record: two line ends, no more."""
        while self._more():
            pass
        if bytes(self._ready) != b"\r\n\r\n":
            raise ValueError("a record does not end with two line ends")
        self._ready.clear()


def records(source, payload: bool) -> Iterator[dict]:
    """Reads a file of records; raises ValueError where framing or a digest is wrong."""
    members = Members(source)
    while members.begin():
        first, *lines = members.until(b"\r\n\r\n").decode().split("\r\n")
        if first.encode() != VERSION:
            raise ValueError(f"not a WARC record: {first[:40]}")
        head = dict(line.split(": ", 1) for line in lines)
        block, body, seen, http, kept = hashlib.sha1(), hashlib.sha1(), 0, b"", []
        for piece in members.take(int(head["Content-Length"])):
            block.update(piece)
            if seen == 0 and (at := (http := http + piece).find(b"\r\n\r\n")) >= 0:
                http, piece, seen = http[: at + 2], http[at + 4 :], 1
            elif seen == 0:
                continue
            body.update(piece)
            seen += len(piece)
            if payload:
                kept.append(piece)
        members.end()
        length = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:] if x)["Content-Length"])
        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
        if head["WARC-Block-Digest"] != "sha1:" + base32(block.digest()):
            raise ValueError("a block does not match its digest")
        if head["WARC-Type"] == "response" and (digest != base32(body.digest()) or seen - 1 != length):
            raise ValueError("a payload does not match its digest or length")
        yield {
            "page_id": int(head["X-Page-Id"]) if "X-Page-Id" in head else None,
            "url": head["WARC-Target-URI"],
            "record_type": head["WARC-Type"],
            "payload_bytes": length,
            "payload_digest": digest,
            "refers_to": int(head["X-Refers-To-Page-Id"]) if "X-Refers-To-Page-Id" in head else None,
            "payload": b"".join(kept) if payload and head["WARC-Type"] == "response" else None,
        }


def write_warc(df: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html", least: int = 0, folder: str | None = None) -> str:
    """Writes the archives into a new folder (of its own in the shared one, if none is given) and returns it. Equal payloads of at least `least` bytes are written once.

    Only digests seen twice or more are joined back, each as one stored row, so that the join's sides are plain shuffles and Spark can split a hot digest's pages."""
    bounded_batches(df.sparkSession)
    folder = folder or fresh_path(df.sparkSession, "warc")
    body = F.coalesce(F.encode(F.col(payload).cast("string"), "UTF-8"), F.lit(b""))
    rows = df.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), body.alias("payload")).withColumn("sha1", F.sha1("payload"))
    again = rows.where(F.length("payload") >= least).groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("sha1").alias("again"), "first")
    again = stored(again, "again")
    rows = rows.join(dealt(again), rows["sha1"] == again["again"], "left").select("page_id", "url", "payload", F.when(F.coalesce(F.col("page_id") > F.col("first"), F.col("first").isNotNull() & F.col("page_id").isNull()), F.col("first")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([member(record(**row))[:-1] for row in batch.to_pylist()], pa.binary())], names=["member"])

    members = rows.mapInArrow(run, "member binary")
    members.select(F.col("member").cast("string").alias("value")).write.option("lineSep", "\0").option("compression", "none").option("maxRecordsPerFile", PER_FILE).text(folder)
    return folder


def read_warc(spark: SparkSession, folder: str, payload: bool = True) -> DataFrame:
    """Reads a folder of archives: page_id, url, record_type, payload_bytes, payload_digest, refers_to and, if asked for, payload (null for revisits)."""
    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", *["payload"] * payload]
    schema = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long" + ", payload binary" * payload
    kinds = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), *[("payload", pa.binary())] * payload])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for content in batch.column("content"):
                with io.BytesIO(memoryview(content.as_buffer())) as source:
                    for r in records(source, payload):
                        held.append({k: r[k] for k in names})
                        size += 200 + len(r["payload"] or b"")
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_pylist(held, schema=kinds)
                            held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=kinds)

    return spark.read.format("binaryFile").load(folder).select("content").mapInArrow(run, schema)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_warc(spark, write_warc(read(spark, sf_dir, "pages")), payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: The digest's base32 letters from groups of five hexadecimal digits.
ORACLE_SQL = """
with p as (select page_id, encode(coalesce(html, '')) as body from pages),
d as (select page_id, octet_length(body) as n, sha1(body) as hex, min(page_id) over (partition by sha1(body)) as first from p),
b as (
  select page_id, n, first, list_transform(range(0, 40, 5), lambda i: cast('0x' || substr(hex, i + 1, 5) as bigint)) as g from d)
select page_id, cast(n as bigint) as payload_bytes,
       array_to_string(list_transform(g, lambda x: array_to_string(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast((x >> s) & 31 as int) + 1, 1)), '')), '') as payload_digest,
       case when page_id = first then 'response' else 'revisit' end as record_type, case when page_id <> first then first end as refers_to
from b
"""
