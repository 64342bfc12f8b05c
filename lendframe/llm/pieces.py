"""SentencePiece BPE encoding and decoding with numpy merge rounds.

A model file is read into two tables: the symbol of each character, and for each pair of symbols the piece they merge into
with its rank by score. Texts are cut where no piece can cross (before a run of spaces, around newlines), each distinct
segment is encoded once. Its symbols lie in one flat array together with those of all other segments; in a round every
segment merges its pair of the lowest rank, the leftmost of equals, all segments at once; segments without a pair leave.
Characters without a piece become byte pieces.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendframe.llm import flat
from lendframe.llm.segments import Segments, framed, spans
from lendframe.llm.tables import send_code

# Piece types of the model format.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
SPACE = "▁"
LONG = 256  # symbols; longer segments are merged one by one with a heap

RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and raw values of a protocol buffer message."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        if tag & 7 == 0:
            value, at = _varint(data, at)
        else:
            size = {1: 8, 5: 4}.get(tag & 7)
            if size is None:
                size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


class PieceModel:
    """A BPE model that leaves characters as they are, puts a space in front and falls back to bytes."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            content = file.read()
        pieces, trainer, normalizer = [], {}, {}
        for number, value in _fields(content):
            if number == 1:
                own = dict(_fields(value))
                score = struct.unpack("<f", own[2])[0] if 2 in own else 0.0
                pieces.append((own[1].decode(), score, own.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normalizer = dict(_fields(value))
        if trainer.get(3) != 2 or not trainer.get(35) or normalizer.get(2) or normalizer.get(4, 1):
            raise ValueError(f"{path} is not a BPE model with byte fallback that leaves texts as they are")
        if any(kind == USER for _, _, kind in pieces):
            raise ValueError(f"{path} has user-defined pieces")
        self.begin, self.end = (trainer.get(n, d) & 0xFFFFFFFF for n, d in ((41, 1), (42, 2)))
        self.byte = np.zeros(256, np.int64)
        for i, (text, _, kind) in enumerate(pieces):
            if kind == BYTE:
                self.byte[int(text[1:-1], 16)] = i
        self._pairs([(i, t, s) for i, (t, s, kind) in enumerate(pieces) if kind == NORMAL], len(pieces))
        self._texts(pieces)

    def _pairs(self, normal: list[tuple[int, str, float]], count: int) -> None:
        symbol = {text: i for i, text, _ in normal}
        self.symbol_of = np.full(0x110000, -1, np.int64)
        self.character = {}  # of symbols that are no pieces
        for char in sorted({c for text in symbol for c in text}):
            if char not in symbol:
                symbol[char] = count + len(self.character)
                self.character[symbol[char]] = ord(char)
            self.symbol_of[ord(char)] = symbol[char]
        self.size, self.pieces = count + len(self.character), count
        order = {score: rank for rank, score in enumerate(sorted({s for _, _, s in normal}, reverse=True))}
        rows = []
        for i, text, score in normal:
            for k in range(1, len(text)):
                left, right = symbol.get(text[:k]), symbol.get(text[k:])
                if left is not None and right is not None:
                    rows.append((left * self.size + right, order[score], i))
        self.keys, self.ranks, self.merged = (np.array(x, np.int64) for x in zip(*sorted(rows), strict=True))
        inner = {text[k : k + 2] for _, text, _ in normal for k in range(len(text) - 1)}
        if any(pair[1] == SPACE != pair[0] for pair in inner) or any("\n" in pair for pair in inner):
            raise ValueError("pieces reach over spaces or newlines")

    def _texts(self, pieces: list[tuple[str, float, int]]) -> None:
        out = []
        for text, _, kind in pieces:
            if kind == BYTE:
                out.append(bytes([int(text[1:-1], 16)]))
            elif kind == CONTROL:
                out.append(b"")
            elif kind == UNKNOWN:
                out.append(" ⁇ ".encode())
            else:
                out.append(text.replace(SPACE, " ").encode())
        self.text_size = np.array([len(x) for x in out], np.int64)
        self.text_start = np.cumsum(self.text_size) - self.text_size
        self.text = np.frombuffer(b"".join(out), np.uint8)
        self.leads = np.array([text.startswith(SPACE) and kind == NORMAL for text, _, kind in pieces])
        self.silent = np.array([kind == CONTROL for _, _, kind in pieces])
        self.is_byte = np.array([kind == BYTE for _, _, kind in pieces])

    def lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of each pair; the rank is very large where a pair doesn't merge."""
        keys = np.where((left >= 0) & (right >= 0), left * self.size + right, -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        found = self.keys[at] == keys
        return np.where(found, self.ranks[at], 1 << 40), self.merged[at]

    def _one_by_one(self, symbols: list[int]) -> list[int]:
        """The same merges for one long segment, in a heap of its pairs."""
        n = len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        ranks, merged = self.lookup(np.array(symbols[:-1]), np.array(symbols[1:]))
        heap = [(int(r), i, symbols[i], symbols[i + 1], int(m)) for i, (r, m) in enumerate(zip(ranks, merged)) if r < 1 << 40]
        heapq.heapify(heap)
        while heap:
            _, i, left, right, piece = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != left or j < 0 or symbols[j] != right:
                continue
            symbols[i], symbols[j], after[i] = piece, -1 << 40, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            near = [x for x in (before[i], i) if x >= 0 and after[x] >= 0]
            ranks, merged = self.lookup(np.array([symbols[x] for x in near]), np.array([symbols[after[x]] for x in near]))
            for x, r, m in zip(near, ranks, merged, strict=True):
                if r < 1 << 40:
                    heapq.heappush(heap, (int(r), x, symbols[x], symbols[after[x]], int(m)))
        return [s for s in symbols if s != -1 << 40]

    def merge(self, symbols: np.ndarray, segment: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
        """Merge rounds over flat symbols with the (ascending) number of the segment of each."""
        done: list[tuple[np.ndarray, np.ndarray]] = []
        long = np.bincount(segment, minlength=segments) > LONG
        for i in np.flatnonzero(long):
            own = np.array(self._one_by_one(symbols[segment == i].tolist()), np.int64)
            done.append((own, np.full(len(own), i)))
        if long.any():
            symbols, segment = symbols[~long[segment]], segment[~long[segment]]
        while len(symbols):
            heads = np.flatnonzero(np.append(True, segment[1:] != segment[:-1]))
            ranks, pieces = self.lookup(symbols[:-1], symbols[1:])
            ranks[segment[1:] != segment[:-1]] = 1 << 40
            ranks, pieces = np.append(ranks, 1 << 40), np.append(pieces, 0)
            # The place in the low bits makes the leftmost of equal ranks the smallest.
            best = np.minimum.reduceat((ranks << 22) | np.arange(len(ranks)), heads)
            sizes = np.diff(np.append(heads, len(symbols)))
            merges = best >> 22 < 1 << 40
            at = best[merges] & ((1 << 22) - 1)
            symbols[at] = pieces[at]
            stays = np.repeat(merges, sizes)
            done.append((symbols[~stays], segment[~stays]))
            stays[at + 1] = False
            symbols, segment = symbols[stays], segment[stays]
        symbols = np.concatenate([x for x, _ in done]) if done else symbols
        segment = np.concatenate([x for _, x in done]) if done else segment
        order = np.argsort(segment, kind="stable")
        return symbols[order], segment[order]

    def encode_segments(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        text = b"".join(pieces).replace(b" ", SPACE.encode()).decode()
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
        sizes = np.array([len(p) if p.isascii() else len(p.decode()) for p in pieces])
        symbols = self.symbol_of[points]
        symbols = np.where(symbols < 0, -1 - points, symbols)
        ids, counts = [], np.zeros(len(pieces), np.int64)
        ends = np.cumsum(sizes)
        begin = 0
        while begin < len(pieces):  # at most about a million symbols in a go
            low = int(ends[begin] - sizes[begin])
            stop = max(begin + 1, int(np.searchsorted(ends, low + (1 << 20), "right")))
            own = np.repeat(np.arange(stop - begin), sizes[begin:stop])
            out, segment = self.merge(symbols[low : ends[stop - 1]].copy(), own, stop - begin)
            out, segment = self._bytes(out, segment)
            ids.append(out)
            counts[begin:stop] = np.bincount(segment, minlength=stop - begin)
            begin = stop
        return np.concatenate(ids).astype(np.int32), counts

    def _bytes(self, symbols: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte pieces in place of symbols that are no pieces."""
        odd = np.flatnonzero((symbols < 0) | (symbols >= self.pieces))
        if not len(odd):
            return symbols, segment
        points = [-1 - s if s < 0 else self.character[s] for s in symbols[odd].tolist()]
        encoded = [chr(p).encode() for p in points]
        sizes = np.ones(len(symbols), np.int64)
        sizes[odd] = [len(e) for e in encoded]
        out, where = np.repeat(symbols, sizes), np.cumsum(sizes) - sizes
        out[spans(where[odd], sizes[odd])] = self.byte[np.frombuffer(b"".join(encoded), np.uint8)]
        return out, np.repeat(segment, sizes)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 of each run of ids, one after the other, and their offsets."""
        ids = ids.astype(np.int64)
        heard = ~self.silent[ids]
        starts, sizes = self.text_start[ids], self.text_size[ids].copy()
        # The first piece that is heard loses the space that encoding puts in front.
        loud = np.flatnonzero(heard)
        first = np.searchsorted(loud, offsets)
        some = first[:-1] < first[1:]
        heads = loud[first[:-1][some]]
        strip = heads[self.leads[ids[heads]]]
        starts[strip] += 1
        sizes[strip] -= 1
        out = self.text[spans(starts, sizes)]
        ends = np.concatenate([[0], np.cumsum(sizes)])[offsets]
        try:
            out.tobytes().decode()
            if not np.any((out[ends[:-1][ends[:-1] < ends[1:]]] & 0xC0) == 0x80):
                return out, ends
        except UnicodeDecodeError:
            pass
        texts = [self._mended(ids[a:b], starts[a:b], sizes[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
        return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])

    def _mended(self, ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> bytes:
        """Decoding of byte pieces that form no valid UTF-8: each stray byte gives one replacement character."""
        out, run = b"", b""
        for i, a, n in [*zip(ids.tolist(), starts.tolist(), sizes.tolist(), strict=True), (-1, 0, 0)]:
            piece = self.text[a : a + n].tobytes()
            if i >= 0 and self.is_byte[i]:
                run += piece
                continue
            while run:
                for n_bytes in (1, 2, 3, 4):
                    try:
                        run[:n_bytes].decode()
                        out, run = out + run[:n_bytes], run[n_bytes:]
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out, run = out + "�".encode(), run[1:]
            out += piece
        return out


@cache
def model(path: str) -> PieceModel:
    return PieceModel(path)


class Encoder:
    """Ids of whole texts, as the sentencepiece library gives them without sampling."""

    def __init__(self, path: str):
        self.model = model(path)
        self.segments = Segments(self.model.encode_segments)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids with begin and end id, offsets)."""
        mark = SPACE.encode()
        if mark in (whole := data.tobytes()):  # the mark itself is read as a space
            texts = [whole[a:b].replace(mark, b" ") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            data = np.frombuffer(b"".join(texts), np.uint8)
            offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
        filled = offsets[:-1] < offsets[1:]
        data = np.insert(data, offsets[:-1][filled], 0x20)
        offsets = offsets + np.concatenate([[0], np.cumsum(filled)])
        space, newline = data == 0x20, data == 0x0A
        cut = space | newline
        cut[1:] &= ~(space[1:] & space[:-1])
        cut[1:] |= newline[:-1]
        ids, counts = self.segments(data, offsets, cut)
        return framed(ids, counts, [self.model.begin], [self.model.end])


@cache
def encoder(path: str) -> Encoder:
    """One per process, so that later tasks find the model loaded and common segments known."""
    return Encoder(path)


def _digests(batches: Iterator[pa.RecordBatch], path: str, with_ids: bool) -> Iterator[pa.RecordBatch]:
    encode = encoder(path)
    for rows, data, offsets in flat.slices(batches):
        ids, ends = encode(data, offsets)
        out, cuts = encode.model.decode(ids, ends)
        little = ids.astype("<u4", copy=False)
        result = {
            "doc_id": rows.column("doc_id"),
            "n_tokens": np.diff(ends),
            "ids_sha256": [hashlib.sha256(little[a:b]).hexdigest() for a, b in zip(ends[:-1], ends[1:])],
            "decoded_sha256": [hashlib.sha256(out[a:b]).hexdigest() for a, b in zip(cuts[:-1], cuts[1:])],
        }
        if with_ids:
            result["ids"] = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32)))
        yield pa.RecordBatch.from_pydict(result)


def encoded(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """One row per row of `docs` (doc_id, text): number of ids, digests of ids and decoded text, on demand the ids.

    A null or empty text has the begin and the end id only and decodes to an empty text. A null doc_id stays null, equal
    rows stay equal rows, an empty table gives an empty result. Other columns are not read. `path` names the model file,
    which every executor must have.
    """
    send_code(docs.sparkSession)
    schema = RESULT + ", ids array<int>" * with_ids
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return docs.mapInArrow(partial(_digests, path=path, with_ids=with_ids), schema)
