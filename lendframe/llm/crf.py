"""A linear-chain conditional random field over word shapes, in numpy.

A token's features are the shape of it and of its neighbours: letters and digits become their class, runs of letters one
sign, every other character stays. One feature is which of a dozen signs occur in it. Features are hashed into a fixed number of rows of weights. Sequences lie one after the
other in flat arrays; training and decoding go through all sequences at once, step by step.
"""

from __future__ import annotations

import numpy as np

from lendframe.llm import flat

ROWS = 4096
TEMPLATES = 5

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("a") : ord("z") + 1] = 2
_CLASS[0x80:] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_SIGN = np.full(256, 1 << 11, np.uint16)
_SIGN[[0x20, *range(0x09, 0x0E)]] = 0
_SIGN[_CLASS == 1], _SIGN[_CLASS == 2], _SIGN[_CLASS == 3] = 1 << 0, 1 << 1, 1 << 2
for _k, _sign in enumerate(b"@.:-()/+"):
    _SIGN[_sign] = 1 << (3 + _k)


def _shapes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, digits: bool) -> np.ndarray:
    """A hash of the shape of each word; with `digits` their number counts, else a run of them is one sign."""
    kind = _CLASS[data]
    keep = np.zeros(len(data) + 1, bool)
    keep[1:-1] = kind[1:] != kind[:-1]
    if digits:
        keep[:-1] |= kind == 3
    keep[starts] = True
    depth = np.zeros(len(data) + 1, np.int8)
    depth[starts] += 1
    depth[stops] -= 1
    keep[:-1] &= np.cumsum(depth[:-1], dtype=np.int8) > 0
    kept = np.flatnonzero(keep[:-1])
    return flat.hashes(kind[kept], np.searchsorted(kept, starts), np.searchsorted(kept, stops))


def sequences(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Numbers of the tokens that begin a sequence: the first of a text, of a line, and after a full stop, ! or ?."""
    begins = np.zeros(len(starts), bool)
    begins[first[:-1][first[:-1] < first[1:]]] = True
    ends = np.isin(data[stops - 1], np.frombuffer(b".!?", np.uint8))
    begins[1:] |= ends[:-1]
    breaks = np.flatnonzero(data == 10)
    after = np.searchsorted(starts, breaks)
    begins[after[after < len(starts)]] = True
    return np.flatnonzero(begins)


def features(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """The weight rows of each token, one per template."""
    n = len(starts)
    exact = (_shapes(data, starts, stops, True) % np.uint64(ROWS - 1)).astype(np.int32) + 1
    rough = (_shapes(data, starts, stops, False) % np.uint64(ROWS - 1)).astype(np.int32) + 1
    before, after = np.zeros(n, np.int32), np.zeros(n, np.int32)
    before[1:], after[:-1] = exact[:-1], exact[1:]
    before[heads] = 0  # row 0 stands for the end of the sequence
    after[heads[1:] - 1] = 0
    signs = np.bitwise_or.reduceat(_SIGN[data], starts).astype(np.int32) if n else np.zeros(0, np.int32)
    return np.stack([exact, rough + ROWS, before + 2 * ROWS, after + 3 * ROWS, signs + 4 * ROWS])


class Field:
    def __init__(self, tags: int):
        self.tags = tags
        self.weights = np.zeros((TEMPLATES * ROWS, tags), np.float32)
        self.moves = np.zeros((tags, tags), np.float32)

    def emissions(self, rows: np.ndarray) -> np.ndarray:
        total = self.weights[rows[0]]
        for own in rows[1:]:
            total = total + self.weights[own]
        return total

    @staticmethod
    def _steps(heads: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Heads of the sequences, longest first, their lengths, and how many sequences have a t-th token."""
        lengths = np.diff(np.append(heads, n))
        order = np.argsort(-lengths, kind="stable")
        heads, lengths = heads[order], lengths[order]
        longest = int(lengths[0]) if len(lengths) else 0
        return heads, lengths, np.searchsorted(-lengths, -np.arange(1, longest + 1), "right")

    def decode(self, rows: np.ndarray, heads: np.ndarray) -> np.ndarray:
        """The best tag of each token (Viterbi); of equal paths the one with smaller tags."""
        score = self.emissions(rows)
        n = len(score)
        heads, lengths, active = self._steps(heads, n)
        back = np.zeros((n, self.tags), np.int8)
        for t in range(1, len(active)):
            at = heads[: active[t]] + t
            paths = score[at - 1][:, :, None] + self.moves
            back[at] = paths.argmax(axis=1)
            score[at] += paths.max(axis=1)
        out = np.zeros(n, np.int8)
        last = heads + lengths - 1
        out[last] = score[last].argmax(axis=1)
        for t in range(len(active) - 1, 0, -1):
            at = heads[: active[t]] + t
            out[at - 1] = back[at, out[at]]
        return out

    def _marginals(self, score: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(tag) of each token and the expected number of moves between tags (forward-backward)."""
        n = len(score)
        heads, lengths, active = self._steps(heads, n)
        forward, backward = score.copy(), np.zeros_like(score)
        for t in range(1, len(active)):
            at = heads[: active[t]] + t
            forward[at] += np.logaddexp.reduce(forward[at - 1][:, :, None] + self.moves, axis=1)
        for t in range(len(active) - 1, 0, -1):
            at = heads[: active[t]] + t
            backward[at - 1] = np.logaddexp.reduce((score[at] + backward[at])[:, None, :] + self.moves, axis=2)
        last = heads + lengths - 1
        whole = np.empty(n, score.dtype)
        norm = np.logaddexp.reduce(forward[last], axis=1)
        whole[np.concatenate([np.arange(h, h + k) for h, k in zip(heads, lengths)])] = np.repeat(norm, lengths)
        inner = np.ones(n, bool)
        inner[heads] = False
        at = np.flatnonzero(inner)
        moves = np.zeros_like(self.moves)
        if len(at):
            joint = forward[at - 1][:, :, None] + self.moves + (score[at] + backward[at])[:, None, :] - whole[at][:, None, None]
            moves = np.exp(joint).sum(axis=0)
        return np.exp(forward + backward - whole[:, None]), moves

    def train(self, rows: np.ndarray, heads: np.ndarray, tags: np.ndarray, rounds: int = 60, rate: float = 0.2, decay: float = 1e-3) -> None:
        """Maximise the penalised conditional likelihood of `tags` by full-batch steps of adapted length."""
        n = len(tags)
        if not n:
            return
        gold = np.eye(self.tags, dtype=np.float32)[tags]
        inner = np.ones(n, bool)
        inner[heads] = False
        at = np.flatnonzero(inner)
        seen = np.zeros_like(self.moves)
        np.add.at(seen, (tags[at - 1], tags[at]), 1)
        power = [np.zeros_like(self.weights), np.zeros_like(self.moves)]
        for _ in range(rounds):
            chance, moves = self._marginals(self.emissions(rows), heads)
            step = np.zeros_like(self.weights)
            for own in rows:
                np.add.at(step, own, gold - chance)
            for values, slope, squares in ((self.weights, step, power[0]), (self.moves, seen - moves, power[1])):
                slope = slope - decay * n * values / 100
                squares += slope * slope
                values += rate * slope / (np.sqrt(squares) + 1e-6)
