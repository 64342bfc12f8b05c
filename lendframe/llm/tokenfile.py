"""Token ids in files of bit or byte planes.

File format, all numbers little-endian:

    magic "PLANES1\\0"
    planes of block 0, of block 1, ...   each plane compressed with zstandard; a plane of zeros only has length 0
    document table                       zstandard: doc ids, then numbers of ids, as two runs of int64
    chunk index                          per block: offset int64, ids int64, crc32 of its ids int64, 4 or 32 lengths int64
    footer                               blocks, ids, documents, offset and length of the table, offset of the index,
                                         unit (1 or 8 bits a plane), null flag position: int64 each, then the magic

A block holds `BLOCK_IDS` ids, the last one of a file the rest. Plane p of a block has bit p (or byte p) of every id, so that
planes of high bits are long runs of equal values. Any block can be read on its own through the index.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lendframe.llm import flat
from lendframe.llm.files import new_file, open_file, partition
from lendframe.llm.segments import Segments, framed, spans
from lendframe.llm.tables import Store

MAGIC = b"PLANES1\0"
BLOCK_IDS = 1 << 18
FILE_IDS = 1 << 26
LEVEL = 1
SLICE_BYTES = 4 << 20  # larger slices repeat more of their segments
FOOTER = 8
NO_ID = -(1 << 63)  # stands for a null doc_id in the document table

MANIFEST = "part int, place int, uri string, documents long, ids long"
RESULT = "doc_id long, start long, n_tokens long, ids_crc32 long"


def to_planes(ids: np.ndarray, unit: int) -> list[np.ndarray]:
    """The planes of uint32 ids, lowest first: 4 of bytes (unit 8) or 32 of packed bits (unit 1)."""
    octets = ids.astype("<u4", copy=False).view(np.uint8).reshape(-1, 4)
    if unit == 8:
        return [np.ascontiguousarray(octets[:, p]) for p in range(4)]
    return [np.packbits((octets[:, p // 8] >> (p % 8)) & 1) for p in range(32)]


def from_planes(planes: list[np.ndarray | None], n: int, unit: int) -> np.ndarray:
    octets = np.zeros((n, 4), np.uint8)
    for p, plane in enumerate(planes):
        if plane is None:
            continue
        if unit == 8:
            octets[:, p] = plane
        else:
            octets[:, p // 8] |= np.unpackbits(plane, count=n) << (p % 8)
    return octets.reshape(-1).view("<u4")


class Writer:
    def __init__(self, stream: object, unit: int = 8):
        self.stream, self.unit = stream, unit
        self.pack = zstandard.ZstdCompressor(level=LEVEL).compress
        self.at, self.ids, self.index = 0, 0, []
        self.docs, self.sizes = [], []
        self.waiting, self.held = [], 0
        self._write(MAGIC)

    def _write(self, data: bytes) -> None:
        self.stream.write(data)
        self.at += len(data)

    def _block(self, ids: np.ndarray) -> None:
        row = [self.at, len(ids), zlib.crc32(ids)]
        for plane in to_planes(ids, self.unit):
            packed = self.pack(plane.tobytes()) if plane.any() else b""
            self._write(packed)
            row.append(len(packed))
        self.index.append(row)
        self.ids += len(ids)

    def add(self, doc_ids: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.docs.append(doc_ids)
        self.sizes.append(sizes)
        self.waiting.append(ids.astype("<u4", copy=False))
        self.held += len(ids)
        if self.held >= BLOCK_IDS:
            ids = np.concatenate(self.waiting)
            whole = len(ids) - len(ids) % BLOCK_IDS
            for a in range(0, whole, BLOCK_IDS):
                self._block(ids[a : a + BLOCK_IDS])
            self.waiting, self.held = [ids[whole:]], len(ids) - whole

    def close(self) -> tuple[int, int]:
        """(documents, ids) of the file."""
        if self.held:
            self._block(np.concatenate(self.waiting))
        docs = np.concatenate([*self.docs, np.empty(0, np.int64)])
        table = self.pack(np.concatenate([docs, *self.sizes]).astype("<i8").tobytes())
        table_at = self.at
        self._write(table)
        index_at = self.at
        self._write(np.array(self.index, "<i8").tobytes())
        footer = [len(self.index), self.ids, len(docs), table_at, len(table), index_at, self.unit, NO_ID]
        self._write(np.array(footer, "<i8").tobytes() + MAGIC)
        self.stream.close()
        return len(docs), self.ids


class Reader:
    def __init__(self, stream: object):
        self.stream = stream
        size = stream.size()
        stream.seek(size - FOOTER * 8 - len(MAGIC))
        tail = stream.read()
        if tail[-len(MAGIC) :] != MAGIC:
            raise ValueError("not a file of planes, or cut off")
        blocks, self.n_ids, docs, table_at, table_size, index_at, self.unit, _ = np.frombuffer(tail[: FOOTER * 8], "<i8").tolist()
        stream.seek(index_at)
        planes = 32 // self.unit
        self.index = np.frombuffer(stream.read(blocks * (3 + planes) * 8), "<i8").reshape(blocks, 3 + planes)
        self.unpack = zstandard.ZstdDecompressor().decompress
        stream.seek(table_at)
        table = np.frombuffer(self.unpack(stream.read(table_size)), "<i8") if docs else np.empty(0, np.int64)
        self.doc_ids, self.sizes = table[:docs], table[docs:]

    def block(self, k: int) -> np.ndarray:
        at, n, crc, *lengths = self.index[k].tolist()
        self.stream.seek(at)
        data, planes = self.stream.read(sum(lengths)), []
        for length in lengths:
            planes.append(np.frombuffer(self.unpack(data[:length]), np.uint8) if length else None)
            data = data[length:]
        ids = from_planes(planes, n, self.unit)
        if zlib.crc32(ids) != crc:
            raise ValueError(f"block {k} is damaged")
        return ids

    def documents(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(doc ids, sizes, ids) of runs of whole documents; memory holds a block and the longest document."""
        rest, done = np.empty(0, "<u4"), 0
        ends = np.cumsum(self.sizes)
        read = 0
        for k in range(len(self.index)):
            rest = np.concatenate([rest, self.block(k)])
            read += int(self.index[k][1])
            upto = int(np.searchsorted(ends, read, "right"))
            if upto > done:
                n = int(self.sizes[done:upto].sum())
                yield self.doc_ids[done:upto], self.sizes[done:upto], rest[:n]
                rest, done = rest[n:], upto


def _solid(data: np.ndarray) -> np.ndarray:
    """Bytes of characters that are surely no white space. From U+0080 on white space begins with C2, E1, E2 or E3."""
    two, three = data == 0xC2, (data >= 0xE1) & (data <= 0xE3)
    odd = two | three
    odd[1:] |= two[:-1] | three[:-1]
    odd[2:] |= three[:-2]
    return (data > 0x20) & (data != 0x7F) & ~odd


class Encoder:
    """Ids of whole texts by a byte-level BPE of the tokenizers library.

    Texts are cut before a space that stands between two characters which are no white space, and around such a newline:
    there the word pattern of this kind of tokenizer always begins a new word. Each distinct segment is encoded once.
    Segments that begin at such a cut are handed over many at a time, joined as they could be in a text, because a call of
    the library costs more than a word; the bytes that each id stands for tell which segment it belongs to.
    """

    JOINED_BYTES = 1 << 17

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.id_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.id_bytes[i] = len(token)  # one character of this alphabet stands for one byte
        self.segments = Segments(self._encode)

    def _ids(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        out = self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)
        arrays = [np.array(e.ids, np.int32) for e in out]
        return np.concatenate([np.empty(0, np.int32), *arrays]), np.array([len(a) for a in arrays], np.int64)

    def _encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([len(p) for p in pieces], np.int64)
        ends = np.cumsum(sizes)
        data = np.frombuffer(b"".join(pieces), np.uint8)
        solid, starts = _solid(data), ends - sizes
        closed = solid[ends - 1]
        spaced = closed & (data[starts] == 0x20) & (sizes > 1) & solid[np.minimum(starts + 1, len(data) - 1)]
        bare = closed & solid[starts]  # stands behind a newline, or as if it did
        regular = np.flatnonzero(spaced | bare)
        joined = [(b"\n" if bare[k] else b"") + pieces[k] for k in regular.tolist()]
        upto = np.cumsum(sizes[regular] + bare[regular])
        lines = np.searchsorted(upto, np.arange(self.JOINED_BYTES, (upto[-1] if len(upto) else 0) + self.JOINED_BYTES, self.JOINED_BYTES))
        cuts = np.unique(np.concatenate([[0], np.minimum(lines + 1, len(joined)), [len(joined)]])).tolist()
        ids, _ = self._ids([b"".join(joined[a:b]) for a, b in zip(cuts[:-1], cuts[1:])])
        reached = np.cumsum(self.id_bytes[ids])
        stop = np.searchsorted(reached, upto) + 1
        if len(upto) and not np.array_equal(reached[np.minimum(stop, len(reached)) - 1], upto):
            raise ValueError("ids reach over the joints of segments: not a byte-level tokenizer of this kind")
        start = np.concatenate([[0], stop[:-1]]) + bare[regular]
        counts = np.zeros(len(pieces), np.int64)
        counts[regular] = stop - start
        others = np.flatnonzero(~(spaced | bare))
        other_ids, counts[others] = self._ids([pieces[k] for k in others.tolist()])
        # Back into the order of the pieces.
        first = np.zeros(len(pieces), np.int64)
        first[regular] = start
        first[others] = len(ids) + np.cumsum(counts[others]) - counts[others]
        return np.concatenate([ids, other_ids])[spans(first, counts)], counts

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        solid = _solid(data)
        cut = np.zeros(len(data), bool)
        breaks = (data == 0x20) | (data == 0x0A)
        cut[1:-1] = breaks[1:-1] & solid[:-2] & solid[2:]
        cut[2:] |= (data[1:-1] == 0x0A) & cut[1:-1]
        return self.segments(data, offsets, cut)


@cache
def encoder(path: str) -> Encoder:
    """One per process, so that later tasks find the tokenizer loaded and common segments known."""
    return Encoder(path)


def _write(batches: Iterator[pa.RecordBatch], path: str, folder: str, end: int, unit: int) -> Iterator[pa.RecordBatch]:
    encode, writer, uri, place, rows_out = encoder(path), None, "", 0, []

    def close() -> None:
        docs, ids = writer.close()
        rows_out.append((partition(), place, uri, docs, ids))

    for rows, data, offsets in flat.slices(batches, limit=SLICE_BYTES):
        if writer is None:
            uri, stream = new_file(folder, ".planes")
            writer = Writer(stream, unit)
        ids, ends = framed(*encode(data, offsets), [], [end])
        doc_ids = rows.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
        writer.add(doc_ids, ids, np.diff(ends))
        if writer.ids >= FILE_IDS:
            close()
            writer, place = None, place + 1
    if writer is not None:
        close()
    if rows_out:
        part, number, uris, docs, ids = zip(*rows_out, strict=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.int32()), pa.array(number, pa.int32()), pa.array(uris), pa.array(docs), pa.array(ids)],
            names=["part", "place", "uri", "documents", "ids"],
        )


def write_tokens(docs: DataFrame, path: str, end: int = 2, unit: int = 8, store: Store | None = None) -> DataFrame:
    """Encode all texts, write them in ascending doc_id order, and return the manifest: one row per file, with the number
    of ids before it in `start`."""
    store = store or Store(docs.sparkSession)
    ordered = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    ordered = ordered.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    write = partial(_write, path=path, folder=f"{store.folder}/tokens", end=end, unit=unit)
    manifest = store.keep(ordered.mapInArrow(write, MANIFEST))
    # One row per file of some dozen million ids.
    before = W.orderBy("part", "place").rowsBetween(W.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file in batch.to_pylist():
            start = file["start"]
            with open_file(file["uri"]) as stream:
                for doc_ids, sizes, ids in Reader(stream).documents():
                    ends = np.cumsum(sizes)
                    crc = [zlib.crc32(ids[a:b]) for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": pa.array(doc_ids, mask=doc_ids == NO_ID),
                            "start": start + ends - sizes,
                            "n_tokens": sizes,
                            "ids_crc32": np.array(crc, np.int64),
                        }
                    )
                    start += int(ends[-1])


def read_tokens(manifest: DataFrame) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids_crc32."""
    files = max(1, manifest.count())
    return manifest.select("uri", "start").repartition(files).mapInArrow(_read, RESULT)


def token_files(docs: DataFrame, path: str, end: int = 2, unit: int = 8) -> DataFrame:
    """Write the ids of all rows of `docs` (doc_id, text) and read them back.

    A null or empty text has the end id only. Rows of a null doc_id come first and keep it; rows of equal doc_id come in
    order of their text. An empty table gives no file and an empty result. Other columns are not read. `path` names the
    tokenizer file, which every executor must have.
    """
    store = Store(docs.sparkSession)
    return read_tokens(store.keep(write_tokens(docs, path, end, unit, store)))
