"""WARC archives as chunked record tables.

Writing: one record per page, gzip-compressed archives below a folder.  A payload longer than
``segment_bytes`` is written as a first segment and ``continuation`` records, as the WARC format
provides for.  Pages with equal payloads of some size become ``revisit`` records that refer to
one response.

Reading: an archive is streamed by one task in small pieces and becomes rows of (record id, chunk
number).  Each chunk carries the SHA-1 of the payload up to its own end, so a record of any length
is digested without ever being held as a whole; the last chunk's digest is the payload's.  Files
are read and written by Spark's own readers and writers, so any store that Spark knows will do.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldscope.llm.common import batches, stored

EOL = b"\r\n"
CHUNK_SCHEMA = (
    "record_id string, chunk_no long, record_type string, uri string, refers_to string, declared_digest string, declared_bytes long, "
    "start long, length long, content binary, sha1 string, last boolean"
)
_CHUNK_ARROW = pa.schema([
    ("record_id", pa.string()), ("chunk_no", pa.int64()), ("record_type", pa.string()), ("uri", pa.string()), ("refers_to", pa.string()),
    ("declared_digest", pa.string()), ("declared_bytes", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("content", pa.binary()),
    ("sha1", pa.string()), ("last", pa.bool_()),
])


def page_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 1000) -> DataFrame:
    """(page_id, uri, payload, digest, record_type, refers_to) of every page row.

    Of equal payloads of at least ``least_bytes`` the largest page_id is the response and smaller
    ids revisit it; rows that repeat that id are responses too, a null id is a revisit.  Null html
    is an empty payload, a null url an empty one.
    """
    records = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.coalesce(F.col(url_col), F.lit("")).alias("uri"),
        F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("digest", F.sha1("payload"))
    large = records.where(F.octet_length("payload") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("winner"), F.count(F.lit(1)).alias("n"))
    # Only payloads that come more than once; written, so that its size is known to the join.
    shared = stored(large.where("n > 1 AND winner IS NOT NULL").select("digest", "winner"), "payloads")
    revisit = F.col("winner").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("winner")))
    return records.join(shared, "digest", "left").select(
        "page_id",
        "uri",
        "payload",
        "digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("winner")).alias("refers_to"),
    )


def _header(*fields: tuple[str, object]) -> bytes:
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields if v is not None) + EOL


def _line(text: str) -> str:
    """A header value on one line."""
    return text.replace("\r", "%0D").replace("\n", "%0A")


def record_pieces(page_id, uri: str, payload: bytes, digest: str, kind: str, refers_to, date: str, segment_bytes: int) -> Iterator[bytes]:
    """The record's segments; each lacks its last line break, which the text writer adds."""
    name = f"<urn:page:{page_id}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = payload if kind == "response" else b""
    cuts = range(0, max(1, len(body)), segment_bytes)
    for number, start in enumerate(cuts, 1):
        block = (http if number == 1 else b"") + body[start : start + segment_bytes]
        many, final = len(cuts) > 1, number == len(cuts)
        yield _header(
            ("WARC-Type", kind if number == 1 else "continuation"),
            ("WARC-Record-ID", name if number == 1 else f"<urn:page:{page_id}:{number}>"),
            ("WARC-Date", date),
            ("WARC-Target-URI", _line(uri)),
            ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode() if number == 1 else None),
            ("WARC-Refers-To", f"<urn:page:{refers_to}>" if refers_to is not None else None),
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if kind == "revisit" else None),
            ("WARC-Segment-Number", number if many else None),
            ("WARC-Segment-Origin-ID", name if number > 1 else None),
            ("WARC-Segment-Total-Length", len(http) + len(body) if many and final and number > 1 else None),
            ("Content-Type", "application/http; msgtype=response" if number == 1 else None),
            ("Content-Length", len(block)),
        ) + block + EOL


def write_archives(records: DataFrame, path: str, date: str = "2000-01-01T00:00:00Z", segment_bytes: int = 1 << 20) -> None:
    """Records (see page_records) -> one gzip archive per task below ``path``."""

    def run(parts):
        def rows():
            for batch in parts:
                columns = [c.to_pylist() if i != 2 else c for i, c in enumerate(batch.columns)]
                for page_id, uri, payload, digest, kind, refers_to in zip(*columns):
                    for piece in record_pieces(page_id, uri, payload.as_py(), digest, kind, refers_to, date, segment_bytes):
                        yield (piece,)

        yield from batches(rows(), pa.schema([("value", pa.binary())]), 64)

    lines = records.select("page_id", "uri", "payload", "digest", "record_type", "refers_to").mapInArrow(run, "value binary")
    writer = lines.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\r\n")
    writer.option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)


class _Reader:
    """Lines of an archive -> chunk rows; holds at most one chunk and one piece of input."""

    def __init__(self, chunk_bytes: int, content: bool):
        self.size, self.content = chunk_bytes, content
        self.state, self.fields, self.left = "between", [], 0
        self.record = None  # of the open record: (id, type, uri, refers_to, digest, bytes)
        self.pending = None

    def _flush(self, last: bool):
        """The buffered bytes as a chunk; it is handed on when it is known whether more follow."""
        if self.buffer or (last and self.number == 0):
            piece = bytes(self.buffer)
            self.sha.update(piece)
            row = [self.record, self.number, self.done, len(piece), piece if self.content else None, self.sha.copy()]
            self.number, self.done = self.number + 1, self.done + len(piece)
            self.buffer.clear()
            held, self.pending = self.pending, row
            if held:
                yield self._row(held, False)
        if last and self.pending:
            yield self._row(self.pending, True)
            self.pending = None

    @staticmethod
    def _row(held, last):
        (rid, kind, uri, refers, digest, size), number, start, length, content, sha = held
        return rid, number, kind, uri, refers, digest, size, start, length, content, sha.hexdigest(), last

    def _open(self):
        head = {}
        for field in self.fields:
            key, _, value = field.partition(b":")
            head[key.strip().lower()] = value.strip().decode("utf-8", "replace")
        self.left = int(head[b"content-length"])
        if head.get(b"warc-type") == "continuation" and self.record and head.get(b"warc-segment-origin-id") == self.record[0]:
            self.http = False
            return
        yield from self.close()
        digest = head.get(b"warc-payload-digest", "")
        digest = base64.b32decode(digest[5:]).hex() if digest.startswith("sha1:") else None
        self.record = [head.get(b"warc-record-id"), head.get(b"warc-type"), head.get(b"warc-target-uri"), head.get(b"warc-refers-to"), digest, None]
        self.http = head.get(b"content-type", "").startswith("application/http")
        self.buffer, self.sha, self.number, self.done = bytearray(), hashlib.sha1(), 0, 0

    def close(self):
        if self.record:
            yield from self._flush(True)
            self.record = None

    def _block(self, piece: bytes):
        at = 0
        while at < len(piece):
            taken = piece[at : at + self.size - len(self.buffer)]
            self.buffer += taken
            at += len(taken)
            if len(self.buffer) == self.size:
                yield from self._flush(False)

    def line(self, line: bytes):
        """One line without its line break."""
        if self.state == "between":
            if line.startswith(b"WARC/"):
                self.state, self.fields = "head", []
            elif line:
                raise ValueError(f"no record begins with {line[:40]!r}")
        elif self.state == "head":
            if line:
                self.fields.append(line)
                return
            yield from self._open()
            self.state = "block" if self.left else "between"
        else:
            ends = len(line) >= self.left
            if len(line) > self.left:
                raise ValueError(f"{self.record[0]}: block longer than its Content-Length")
            piece = line if ends else line + EOL[: self.left - len(line)]
            self.left -= len(piece)
            if self.http:
                if line[:15].lower() == b"content-length:":
                    self.record[5] = int(line[15:])
                self.http = bool(line)
            else:
                yield from self._block(piece)
            if not self.left:
                self.state = "between"


def read_chunks(spark: SparkSession, path: str, chunk_bytes: int = 1 << 16, content: bool = True) -> DataFrame:
    """Archives below ``path`` -> chunk table (CHUNK_SCHEMA), chunks of a record in order.

    Every record has at least one chunk; an empty payload gives one of length 0.  sha1 is the
    digest of the payload up to the chunk's end; with ``content`` false the bytes themselves are
    left out.  A compressed archive is one task's stream, so a record's chunks stay together.
    """

    def run(parts):
        reader = _Reader(chunk_bytes, content)

        def rows():
            for batch in parts:
                for cell in batch.column(0):
                    yield from reader.line(cell.as_py())
            yield from reader.close()

        yield from batches(rows(), _CHUNK_ARROW, 256)

    lines = spark.read.option("lineSep", "\r\n").text(path).select(F.col("value").cast("binary"))
    return lines.mapInArrow(run, CHUNK_SCHEMA)


def records_of(chunks: DataFrame) -> DataFrame:
    """One row per record from its last chunk: page_id, payload_bytes, payload_digest, record_type, refers_to, intact.

    A revisit has no payload of its own: size and digest are those it declares.  ``intact`` says
    whether a response's digest is the one its header declares.
    """
    own = F.col("record_type") == "response"
    number = lambda c: F.regexp_extract(c, r"<urn:page:(-?\d+)", 1).try_cast("long")
    return chunks.where("last").select(
        number("record_id").alias("page_id"),
        F.when(own, F.col("start") + F.col("length")).otherwise(F.col("declared_bytes")).alias("payload_bytes"),
        F.when(own, F.col("sha1")).otherwise(F.col("declared_digest")).alias("payload_digest"),
        "record_type",
        number("refers_to").alias("refers_to"),
        F.when(own, F.col("sha1") == F.col("declared_digest")).alias("intact"),
    )
