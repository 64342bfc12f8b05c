"""Counting quotient filters of packed word-id n-grams: compact, sorted and lossless.

An n-gram of ids of `bits` bits is packed into two or three integers of up to 64 bits, which unequal Feistel rounds permute
invertibly, so that equal n-grams have equal keys, keys are spread evenly whatever the words are, and a key gives its words
back. A filter holds the keys of one range (their leading bits) in order: the next bits, the quotient, are told by a bit
vector of the quotients that occur and one of the ends of their runs; all other bits, the full remainder, are stored as they
are, and so is the count if it is above 1. Filters of one range are merged by sorting what they hold.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

from lendframe.llm.flat import mix

ROUNDS = 6
HEAD = struct.Struct("<IBI")

Parts = list[np.ndarray]


@dataclass(frozen=True)
class Layout:
    """How n ids of `bits` bits (32 at most) are laid out: words per part and width of each part in bits."""

    n: int
    bits: int

    @property
    def words(self) -> list[int]:
        parts = 2 if -(-self.n // 2) * self.bits <= 64 else -(-self.n // 2)
        return [self.n // parts + (k < self.n % parts) for k in range(parts)]

    @property
    def widths(self) -> list[int]:
        return [w * self.bits for w in self.words]


def _mask(width: int) -> np.uint64:
    return np.uint64((1 << width) - 1)


def pack(ids: Parts, layout: Layout) -> Parts:
    """One array of ids per word of the n-gram, as parts."""
    out, at = [], 0
    for w in layout.words:
        part = ids[at].astype(np.uint64)
        for k in range(at + 1, at + w):
            part = (part << np.uint64(layout.bits)) | ids[k].astype(np.uint64)
        out.append(part)
        at += w
    return out


def unpack(parts: Parts, layout: Layout) -> Parts:
    out = []
    for w, part in zip(layout.words, parts, strict=True):
        out += [(part >> np.uint64(layout.bits * k)) & _mask(layout.bits) for k in range(w - 1, -1, -1)]
    return out


def _round(parts: Parts, r: int, layout: Layout) -> None:
    own = r % len(parts)
    salt = np.uint64((r + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    for k, part in enumerate(parts):
        if k != own:
            salt = mix(part + salt)
    parts[own] = parts[own] ^ (salt >> np.uint64(64 - layout.widths[own]))


def permute(parts: Parts, layout: Layout) -> Parts:
    parts = list(parts)
    for r in range(ROUNDS):
        _round(parts, r, layout)
    return parts


def restore(parts: Parts, layout: Layout) -> Parts:
    parts = list(parts)
    for r in reversed(range(ROUNDS)):
        _round(parts, r, layout)
    return parts


def sorted_groups(parts: Parts, layout: Layout) -> tuple[np.ndarray, np.ndarray]:
    """(order, heads): the order that sorts the keys, and where in it a new key begins."""
    if sum(layout.widths) <= 64:
        key = np.zeros(len(parts[0]), np.uint64)
        for part, width in zip(parts, layout.widths, strict=True):
            key = (key << np.uint64(width)) | part
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = key[1:] != key[:-1]
    else:
        order = np.lexsort(parts[::-1])
        new = np.zeros(max(0, len(order) - 1), bool)
        for part in parts:
            part = part[order]
            new |= part[1:] != part[:-1]
    return order, np.flatnonzero(np.append(True, new)[: len(order)])


def range_of(parts: Parts, layout: Layout, range_bits: int) -> np.ndarray:
    """The leading bits of each key."""
    return (parts[0] >> np.uint64(layout.widths[0] - range_bits)) if range_bits else np.zeros(len(parts[0]), np.uint64)


def _remainders(layout: Layout, range_bits: int, quotient: int) -> list[int]:
    """Bytes of each part that are stored: what range and quotient leave of the first one, and the others."""
    return [-(-w // 8) for w in (layout.widths[0] - range_bits - quotient, *layout.widths[1:])]


def encode(parts: Parts, counts: np.ndarray, layout: Layout, range_bits: int) -> bytes:
    """The filter of sorted distinct keys of one range and their counts."""
    m = len(counts)
    free = layout.widths[0] - range_bits
    # About one key a quotient; the remainder of the first part fills whole bytes.
    quotient = min(free, max(0, m.bit_length() - 1))
    quotient = max(0, quotient - (-(free - quotient)) % 8)
    low = parts[0] & _mask(free)
    rest = free - quotient
    of = (low >> np.uint64(rest)).astype(np.int64) if rest < 64 else np.zeros(m, np.int64)
    occupied = np.zeros(1 << quotient, bool)
    occupied[of] = True
    ends = np.append(of[1:] != of[:-1], True)[:m]
    stored = []
    for part, size in zip([low & _mask(rest), *parts[1:]], _remainders(layout, range_bits, quotient), strict=True):
        stored.append(part.astype("<u8").view(np.uint8).reshape(m, 8)[:, :size].tobytes())
    many = counts > 1
    small = np.minimum(counts[many], 255).astype(np.uint8)
    large = counts[many][small == 255].astype("<u8")
    vectors = (np.packbits(x).tobytes() for x in (occupied, ends, many))
    return b"".join([HEAD.pack(m, quotient, len(small)), *vectors, *stored, small.tobytes(), large.tobytes()])


@dataclass
class Filter:
    """A filter as read: `occupied` and `ends` as bits, remainders of each part, counts."""

    quotient: int
    rest: int
    occupied: np.ndarray
    ends: np.ndarray
    remainders: Parts
    counts: np.ndarray

    def keys(self, number: int, layout: Layout, range_bits: int) -> Parts:
        """The sorted keys, as parts, of the filter of range `number`."""
        runs = np.cumsum(np.append(0, self.ends[:-1])) if len(self.ends) else np.empty(0, np.int64)
        high = np.flatnonzero(self.occupied)[runs].astype(np.uint64)
        first = self.remainders[0]
        if self.rest < 64:
            first = first | (high << np.uint64(self.rest))
        if range_bits:
            first = first | (np.uint64(number) << np.uint64(layout.widths[0] - range_bits))
        return [first, *self.remainders[1:]]

    def count_of(self, parts: Parts, layout: Layout, range_bits: int) -> np.ndarray:
        """Counts of keys of this range, 0 for those it does not hold: the run of the quotient by rank and select, and a
        binary search in the run."""
        low = parts[0] & _mask(layout.widths[0] - range_bits)
        of = (low >> np.uint64(self.rest)).astype(np.int64) if self.rest < 64 else np.zeros(len(low), np.int64)
        asked = [low & _mask(self.rest), *parts[1:]]
        if not len(self.counts):
            return np.zeros(len(low), np.int64)
        run = np.cumsum(self.occupied)[of] - 1
        select = np.flatnonzero(self.ends)
        there = self.occupied[of]
        low_at = np.where(there & (run > 0), select[np.maximum(run - 1, 0)] + 1, 0)
        stop = np.where(there, select[np.maximum(run, 0)] + 1, 0)
        low_at = np.where(there, low_at, 0)
        high_at = stop.copy()
        while (open_ := low_at < high_at).any():
            mid = (low_at + high_at) // 2
            at = np.minimum(mid, len(self.counts) - 1)
            less, same = np.zeros(len(at), bool), np.ones(len(at), bool)
            for own, other in zip(self.remainders, asked, strict=True):
                less |= same & (own[at] < other)
                same &= own[at] == other
            low_at = np.where(open_ & less, mid + 1, low_at)
            high_at = np.where(open_ & ~less, mid, high_at)
        at = np.minimum(low_at, len(self.counts) - 1)
        hit = there & (low_at < stop)
        for own, other in zip(self.remainders, asked, strict=True):
            hit &= own[at] == other
        return np.where(hit, self.counts[at], 0)


def decode(data: bytes, layout: Layout, range_bits: int) -> Filter:
    m, quotient, n_many = HEAD.unpack_from(data)
    at = HEAD.size

    def bits(n: int) -> np.ndarray:
        nonlocal at
        size = -(-n // 8)
        found = np.unpackbits(np.frombuffer(data, np.uint8, size, at), count=n).astype(bool)
        at += size
        return found

    occupied, ends, many = bits(1 << quotient), bits(m), bits(m)
    remainders = []
    for size in _remainders(layout, range_bits, quotient):
        wide = np.zeros((m, 8), np.uint8)
        wide[:, :size] = np.frombuffer(data, np.uint8, m * size, at).reshape(m, size)
        remainders.append(wide.view("<u8").reshape(m).astype(np.uint64))
        at += m * size
    small = np.frombuffer(data, np.uint8, n_many, at).astype(np.int64)
    at += n_many
    small[small == 255] = np.frombuffer(data, "<u8", (len(data) - at) // 8, at).astype(np.int64)
    counts = np.ones(m, np.int64)
    counts[many] = small
    return Filter(quotient, layout.widths[0] - range_bits - quotient, occupied, ends, remainders, counts)


def merged(keys: list[Parts], counts: list[np.ndarray], layout: Layout) -> tuple[Parts, np.ndarray, np.ndarray]:
    """(keys, counts, group): sorted distinct keys of several sorted filters, their summed counts, and for every entry of
    the filters, one after the other, the number of its key."""
    parts = [np.concatenate(p) for p in zip(*keys, strict=True)]
    order, heads = sorted_groups(parts, layout)
    total = np.add.reduceat(np.concatenate(counts)[order], heads) if len(order) else np.empty(0, np.int64)
    group = np.empty(len(order), np.int64)
    group[order] = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(order))))
    return [p[order[heads]] for p in parts], total, group
