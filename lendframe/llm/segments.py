"""Tokenise each distinct piece of text once: cut texts where no token can cross, encode what is new, gather the rest."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from lendframe.llm import flat

CACHED = 1_200_000

Encode = Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of all spans, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) - np.repeat(ends - lengths - starts, lengths)


class Segments:
    """Ids of texts that come cut into segments. `encode` turns segments into (ids one after the other, counts).

    Up to `CACHED` segments are remembered between calls; beyond that the memory starts anew, which changes no result.
    """

    def __init__(self, encode: Encode):
        self.encode = encode
        self.clear()

    def clear(self) -> None:
        self.keys, self.rows = np.empty(0, np.uint64), np.empty(0, np.int32)  # sorted by key
        self.ids, self.starts, self.counts = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int32)

    def __call__(self, data: np.ndarray, offsets: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts per text); `cut` marks the bytes at which a segment begins, besides the first of a text."""
        texts = len(offsets) - 1
        if not len(data):
            return np.empty(0, np.int32), np.zeros(texts, np.int64)
        cut[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        starts = np.flatnonzero(cut)
        stops = np.append(starts[1:], len(data))
        keys, index, inverse = np.unique(flat.hashes(data, starts, stops), return_index=True, return_inverse=True)
        if len(self.keys) > CACHED:
            self.clear()
        rows = np.full(len(keys), -1, np.int32)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            rows = np.where(self.keys[at] == keys, self.rows[at], rows)
        new = np.flatnonzero(rows < 0)
        if len(new):
            whole = data.tobytes()
            pieces = [whole[a:b] for a, b in zip(starts[index[new]].tolist(), stops[index[new]].tolist(), strict=True)]
            ids, counts = self.encode(pieces)
            rows[new] = len(self.counts) + np.arange(len(new), dtype=np.int32)
            self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(counts) - counts])
            self.ids, self.counts = np.concatenate([self.ids, ids]), np.concatenate([self.counts, counts.astype(np.int32)])
            merged = np.concatenate([self.keys, keys[new]])
            order = np.argsort(merged, kind="stable")  # two sorted runs
            self.keys, self.rows = merged[order], np.concatenate([self.rows, rows[new]])[order]
        rows = rows[inverse]
        counts = self.counts[rows].astype(np.int64)
        total = np.concatenate([[0], np.cumsum(counts)])
        first = np.searchsorted(starts, offsets)
        return self.ids[spans(self.starts[rows], counts)], total[first[1:]] - total[first[:-1]]


def framed(ids: np.ndarray, counts: np.ndarray, before: list[int], after: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of each text between fixed ids, one text after the other; and the offsets of the texts."""
    sizes = counts + len(before) + len(after)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(offsets[-1], np.uint32)
    for k, x in enumerate(before):
        out[offsets[:-1] + k] = x
    for k, x in enumerate(after):
        out[offsets[1:] - len(after) + k] = x
    out[spans(offsets[:-1] + len(before), counts)] = ids
    return out, offsets
