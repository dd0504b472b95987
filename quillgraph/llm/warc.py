"""Operator 6: WARC archives with a sequential reader.

The writer makes WARC 1.1 files of one gzip member a record.  The reader takes
a file from front to back: it inflates in small pieces, learns where a member
ends from what the inflater leaves over, frames the record by its content
length and checks block and payload digests.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import new_path, open_file, put_file, slices, written

DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PIECE = 64 << 10
#: A file of so many bytes is closed and another begun.
FILE_BYTES = 1 << 30


def digest(data: bytes) -> str:
    """The bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(key: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, key)}>"


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes
    http: dict[str, str] = field(default_factory=dict)
    payload: bytes = b""

    @property
    def kind(self) -> str:
        return self.headers["WARC-Type"]


def _line(text: str) -> str:
    return text.replace("\r", "%0D").replace("\n", "%0A")


def record_bytes(kind: str, uri: str | None, own_id: str, payload: bytes, fields: dict[str, str] | None = None) -> bytes:
    """One record as a gzip member.  A revisit's block is the HTTP head alone,
    whose content length is that of the payload it stands for."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    head = {"WARC-Type": kind, "WARC-Record-ID": own_id, "WARC-Date": DATE}
    if uri is not None:
        head["WARC-Target-URI"] = _line(uri)
    head |= {"WARC-Payload-Digest": f"sha1:{digest(payload)}", "WARC-Block-Digest": f"sha1:{digest(block)}", **(fields or {}), "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    raw = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw.encode() + block + b"\r\n\r\n") + z.flush()


def info_bytes(name: str) -> bytes:
    block = b"software: quillgraph\r\nformat: WARC File Format 1.1\r\n"
    raw = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: {record_id(name)}\r\nWARC-Date: {DATE}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(block)}\r\n\r\n".encode()
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw + block + b"\r\n\r\n") + z.flush()


class Reader:
    """Records of a file, one after another; memory holds one record."""

    def __init__(self, file):
        self.file, self.ahead = file, b""

    def _member(self) -> bytearray | None:
        """The inflated bytes of the next gzip member."""
        data = self.ahead or self.file.read(PIECE)
        if not data:
            return None
        z, out = zlib.decompressobj(31), bytearray()
        while True:
            out += z.decompress(data)
            if z.eof:
                self.ahead = z.unused_data
                return out
            data = self.file.read(PIECE)
            if not data:
                raise ValueError("the last member ends early")

    def __iter__(self) -> Iterator[Record]:
        while (raw := self._member()) is not None:
            end = raw.find(b"\r\n\r\n")
            lines = raw[: max(end, 0)].decode("utf-8").split("\r\n")
            if end < 0 or not lines[0].startswith("WARC/"):
                raise ValueError("no WARC record")
            head = dict(x.split(": ", 1) for x in lines[1:])
            n = int(head["Content-Length"])
            block = bytes(raw[end + 4 : end + 4 + n])
            if len(block) != n or raw[end + 4 + n :] != b"\r\n\r\n":
                raise ValueError(f"{head.get('WARC-Record-ID')}: the content length is wrong")
            record = Record(head, block)
            check = lambda name, data: name not in head or head[name] == f"sha1:{digest(data)}"  # noqa: B023, E731
            if not check("WARC-Block-Digest", block):
                raise ValueError(f"{head['WARC-Record-ID']}: the block differs from its digest")
            if record.kind in ("response", "revisit"):
                http, _, record.payload = block.partition(b"\r\n\r\n")
                record.http = dict(x.split(": ", 1) for x in http.decode("latin-1").split("\r\n")[1:])
                if record.kind == "response" and not check("WARC-Payload-Digest", record.payload):
                    raise ValueError(f"{head['WARC-Record-ID']}: the payload differs from its digest")
            yield record


def with_originals(pages: DataFrame, least: int = 0) -> DataFrame:
    """Adds ``refers_to``: the smallest page_id of an equal payload of at least
    ``least`` bytes, where that is another one; and ``single``: whether that
    smallest page_id stands there once, so that its record can be named.  Payloads
    are grouped by their digest; only groups of several are joined back."""
    key = F.sha1(F.col("payload"))
    keys = pages.select("page_id", key.alias("k"), F.octet_length("payload").alias("n")).where(F.col("n") >= least)
    each = keys.groupBy("k", "page_id").agg(F.count(F.lit(1)).alias("c"))
    low = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "c")))
    first = each.groupBy("k").agg(low.alias("f"), F.sum("c").alias("c")).where("c > 1")
    first = written(first.select("k", F.col("f.page_id").alias("first"), (F.coalesce("f.c", F.lit(0)) == 1).alias("single")), "originals")
    out = pages.withColumn("k", key).join(first, "k", "left")
    refers = F.when((F.octet_length("payload") >= least) & (F.col("first") != F.col("page_id")), F.col("first"))
    # a payload below ``least`` is not grouped, so whether its page_id repeats is not known
    alone = F.when(F.octet_length("payload") < least, False).when(F.col("page_id").isNull(), False).otherwise(F.coalesce("single", F.lit(True)))
    return out.withColumns({"refers_to": refers, "single": alone}).drop("k", "first")


def write_archives(pages: DataFrame, to: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes (page_id, url, payload, refers_to, single) in archives of about
    ``file_bytes`` at most; rows: uri, records, bytes.

    A response that stands alone is named by its page_id and payload, and its
    revisits name it; all other records are named by their place in the file, so
    that no two records share a name.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ctx = TaskContext.get()
        rows = (r for b in batches for part in slices(b, "payload", 1 << 20) for r in part.to_pylist())
        head, number = next(rows, None), 0
        while head is not None:
            name = f"pages-{ctx.partitionId():06d}-{ctx.taskAttemptId()}-{number:04d}.warc.gz"
            state = {"next": head, "n": 0}

            def chunks(name: str = name, state: dict = state) -> Iterator[bytes]:
                size = len(info := info_bytes(name))
                yield info
                while (r := state["next"]) is not None and (size < file_bytes or not state["n"]):
                    fields = {"X-Page-ID": "" if r["page_id"] is None else str(r["page_id"])}
                    named = lambda page_id: record_id(f"page:{page_id}:{digest(r['payload'])}")  # noqa: B023, E731
                    own, kind = f"{name}:{state['n']}", "response" if r["refers_to"] is None else "revisit"
                    if kind == "revisit":
                        fields |= {"WARC-Refers-To": named(r["refers_to"])} if r["single"] else {}
                        fields |= {"WARC-Profile": PROFILE, "X-Refers-To-Page-ID": str(r["refers_to"])}
                    data = record_bytes(kind, r["url"], named(r["page_id"]) if kind == "response" and r["single"] else record_id(own), r["payload"], fields)
                    state["n"] += 1
                    size += len(data)
                    yield data
                    state["next"] = next(rows, None)

            size = put_file(f"{to}/{name}", chunks())
            yield pa.RecordBatch.from_pylist([{"uri": f"{to}/{name}", "records": state["n"], "bytes": size}])
            head, number = state["next"], number + 1

    rows = pages.select("page_id", "url", "payload", "refers_to", "single")
    return written(rows.mapInArrow(write, "uri string, records long, bytes long"), "archives")


_READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def read_archives(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """Reads archives back, a task a file: page_id, url, payload_bytes,
    payload_digest, record_type, refers_to, payload (null unless asked for)."""
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = archives.sparkSession
    schema = to_arrow_schema(T.StructType.fromDDL(_READ))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri in b.column(0).to_pylist():
                out, held = [], 0
                with open_file(uri) as f:
                    for r in Reader(f):
                        if r.kind not in ("response", "revisit"):
                            continue
                        number = lambda x: int(x) if x else None
                        n = len(r.payload) if r.kind == "response" else int(r.http["Content-Length"])
                        out.append({"page_id": number(r.headers.get("X-Page-ID")), "url": r.headers.get("WARC-Target-URI"), "payload_bytes": n, "payload_digest": r.headers["WARC-Payload-Digest"].removeprefix("sha1:"), "record_type": r.kind, "refers_to": number(r.headers.get("X-Refers-To-Page-ID")), "payload": r.payload if payloads and r.kind == "response" else None})
                        held += len(r.payload) if payloads else 0
                        if len(out) == 2000 or held > 4 << 20:
                            yield pa.RecordBatch.from_pylist(out, schema=schema)
                            out, held = [], 0
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    return archives.select("uri").repartition(4 * spark.sparkContext.defaultParallelism, "uri").mapInArrow(read, _READ)


def archived(pages: DataFrame, least: int = 0) -> DataFrame:
    """Writes pages and reads them back: page_id, payload_bytes, payload_digest,
    record_type, refers_to.

    The payload is the html in UTF-8 (null: empty).  Rows with the smallest
    identifier of a group are responses, all of them if it repeats; so is a row
    with a null identifier, which nothing refers to.  Payloads may be of any length; a record is held in memory whole.
    An empty table gives no rows; other columns, whatever their names, are ignored.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "utf-8").alias("payload"))
    rows = with_originals(rows, least)
    tables = write_archives(rows, new_path(pages.sparkSession, "warc"))
    return read_archives(tables).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(spark.read.parquet(f"{sf_dir}/pages.parquet"), 0)


#: The digest's 160 bits in letters of five: five hexadecimal digits are four letters.
SQL = """
WITH paid AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY payload) AS first FROM paid)
SELECT page_id, strlen(payload) AS payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(hex, (i // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1)::BIGINT, 1) FOR i IN range(32)], '') AS payload_digest,
       CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM firsts"""
