"""Web archives of individually compressed records that share a dictionary (.warc.zst), and reading them back.

A file begins with a skippable frame that holds a Zstandard dictionary, built from the first records of the file; each
record is a frame of its own, compressed with that dictionary. Pages of equal payload are written once: the page of the
largest page_id is a response record, the others are revisit records that name it.

Tasks write the rows they read, so pages are not shuffled. Who refers to whom comes from an aggregation of digests.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendframe.llm.files import new_file, open_file, partition
from lendframe.llm.tables import Store

DICTIONARY_FRAME = 0x184D2A5D
DICTIONARY_BYTES, SAMPLE_BYTES = 64 << 10, 2 << 20
FILE_BYTES = 256 << 20
LEVEL = 3
READ_BYTES = 64 << 10
BROADCAST_GROUPS = 200_000
DATE = "2024-01-01T00:00:00Z"

MANIFEST = "part int, uri string, records long"
RESULT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page_id(record_id: str | None) -> int | None:
    value = (record_id or "<urn:page:none>").rsplit(":", 1)[1].rstrip(">")
    return None if value == "none" else int(value)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One WARC/1.1 record. A revisit has the HTTP head only, which keeps the length of the payload."""
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "about:blank")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    fields = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": _record_id(page_id),
        "WARC-Date": date,
        "WARC-Target-URI": target,
        "WARC-Payload-Digest": f"sha1:{base32_sha1(payload)}",
    }
    if revisit:
        fields["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        fields["WARC-Refers-To"] = _record_id(refers_to)
    fields |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    head = "".join(f"{name}: {value}\r\n" for name, value in fields.items())
    return f"WARC/1.1\r\n{head}\r\n".encode() + block + b"\r\n\r\n"


def dictionary(samples: list[bytes]) -> bytes:
    """A dictionary of these records; where they are too few to train one, their own text is one."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES]


class Writer:
    """Holds the first records back until there is enough to build the dictionary from."""

    def __init__(self, folder: str):
        self.uri, self.stream = new_file(folder, ".warc.zst")
        self.waiting, self.held, self.records, self.size, self.pack = [], 0, 0, 0, None

    def add(self, data: bytes) -> None:
        self.records += 1
        if self.pack:
            self._write(data)
            return
        self.waiting.append(data)
        self.held += len(data)
        if self.held >= SAMPLE_BYTES:
            self._begin()

    def _begin(self) -> None:
        content = dictionary(self.waiting)
        self.stream.write(struct.pack("<II", DICTIONARY_FRAME, len(content)) + content)
        shared = zstandard.ZstdCompressionDict(content)
        shared.precompute_compress(level=LEVEL)
        self.pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_checksum=True).compress
        for data in self.waiting:
            self._write(data)
        self.waiting = []

    def _write(self, data: bytes) -> None:
        packed = self.pack(data)
        self.size += len(packed)
        self.stream.write(packed)

    def close(self) -> tuple[int, str, int]:
        if not self.pack:
            self._begin()
        self.stream.close()
        return partition(), self.uri, self.records


def _write(batches: Iterator[pa.RecordBatch], folder: str, date: str) -> Iterator[pa.RecordBatch]:
    writer, done = None, []
    for batch in batches:
        for k in range(batch.num_rows):
            page_id, url, html, refers_to, revisit = (column[k].as_py() for column in batch.columns)
            writer = writer or Writer(folder)
            writer.add(record(page_id, url, (html or "").encode(), refers_to, revisit, date))
            if writer.size >= FILE_BYTES:
                done.append(writer.close())
                writer = None
    if writer:
        done.append(writer.close())
    if done:
        part, uri, records = zip(*done, strict=True)
        names = ["part", "uri", "records"]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(uri), pa.array(records, pa.int64())], names)


def frames(stream: object) -> Iterator[bytes]:
    """The records of an archive, one frame after the other; memory holds one record and a small buffer."""
    magic, size = struct.unpack("<II", stream.read(8))
    if magic != DICTIONARY_FRAME:
        raise ValueError("the file does not begin with a dictionary frame")
    unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(stream.read(size)))
    rest = b""
    while rest or (rest := stream.read(READ_BYTES)):
        frame, parts = unpack.decompressobj(), []
        while not frame.eof:
            parts.append(frame.decompress(rest))
            rest = frame.unused_data if frame.eof else stream.read(READ_BYTES)
            if not frame.eof and not rest:
                raise ValueError("the archive is cut off")
        yield b"".join(parts)


def parse(data: bytes) -> tuple[int | None, int, str, str, int | None]:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of a record; a damaged payload is an error."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"\r\nContent-Length: ([0-9]+)", http)[1])
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if version != "WARC/1.1" or kind == "response" and (len(payload) != length or base32_sha1(payload) != digest):
        raise ValueError(f"{fields.get('WARC-Record-ID')} is damaged")
    refers_to = _page_id(fields.get("WARC-Refers-To")) if kind == "revisit" else None
    return _page_id(fields["WARC-Record-ID"]), length, digest, kind, refers_to


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    for batch in batches:
        for uri in batch.column(0).to_pylist():
            rows = []
            with open_file(uri) as stream:
                for data in frames(stream):
                    rows.append(parse(data))
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                        rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def write_archives(pages: DataFrame, store: Store, least_bytes: int = 0, date: str = DATE) -> DataFrame:
    """Write a record per row and return the manifest, one row per archive file."""
    pages = pages.select(
        F.col("page_id").cast("long"),
        F.col("url").cast("string"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    )
    pages = pages.withColumn("digest", F.sha1("html"))
    groups = pages.where(F.octet_length("html") >= least_bytes).groupBy("digest")
    groups = store.keep(groups.agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    # Few groups are sent to every task, many are joined by digest, where adaptive execution splits a hot one.
    small = groups.count() <= BROADCAST_GROUPS
    named = pages.join(F.broadcast(groups) if small else groups, "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    rows = named.select("page_id", "url", "html", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("r"))
    return store.keep(rows.mapInArrow(partial(_write, folder=f"{store.folder}/archives", date=date), MANIFEST))


def read_archives(manifest: DataFrame) -> DataFrame:
    return manifest.select("uri").repartition(max(1, manifest.count())).mapInArrow(_read, RESULT)


def archives(pages: DataFrame, least_bytes: int = 0, date: str = DATE) -> DataFrame:
    """Write all rows of `pages` (page_id, url, html) to archives and read them back, one row per record.

    A null html is an empty payload. Payloads of `least_bytes` or more are written once per content: rows of the largest
    page_id of a group are responses (rows that repeat this id too), the others revisits. A null page_id stays null and
    refers to the page that has an id; where all are null, all are responses. A null url becomes about:blank, spaces and
    control characters of a url are escaped. An empty table gives no file and an empty result. Other columns are not read.
    """
    return read_archives(write_archives(pages, Store(pages.sparkSession), least_bytes, date))


SQL = """
WITH digests AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), grouped AS (
  SELECT *, max(page_id) OVER (PARTITION BY hex) AS first FROM digests
)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         (((('0x' || substr(hex, 1 + 5 * (i // 4)::INTEGER, 5))::BIGINT >> (15 - 5 * (i % 4))::INTEGER) & 31) + 1)::INTEGER, 1)),
         'string_agg', '') AS payload_digest,
       CASE WHEN page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM grouped
"""
