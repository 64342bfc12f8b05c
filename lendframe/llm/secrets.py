"""Secrets in texts: fixed patterns, and candidates whose format a probabilistic automaton of credentials accepts.

Automata are inferred over classes of characters: one per kind from what the patterns find in a bounded sample of the
documents, and one per format of a small labelled table of credentials (`CREDENTIALS`). One more is inferred from ordinary
runs of the sample. Candidates are all runs of credential characters outside the patterns' spans, parts of touched runs too,
of `CANDIDATE_CHARS` or more, without signs at their ends (but with padding) and cut behind an equals sign. One counts if
its likelihood per character is no lower than that of the least likely of the labelled values of a format, but for
`OUTLIERS` of them, and higher than that of ordinary text. Spans it adds never overlap those of the patterns.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendframe.llm import flat
from lendframe.llm.automata import Automaton
from lendframe.llm.tables import sampled_texts

KINDS = "assign", "access", "hex"
TRAIN_ROWS, TRAIN_CHARS, TRAIN_VALUES = 600, 20_000, 400
ORDINARY_RUNS = 1000
CANDIDATE_CHARS, OUTLIERS = 12, 0.02

RESULT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_added long"

_KEYWORDS = b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key"
_VALUE = re.compile(rb"\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")

# Classes of credential characters; others are no credential characters.
_CLASSES = b"abcdef", b"ghijklmnopqrstuvwxyz", b"ABCDEF", b"GHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"+", b"/", b"_", b".", b"=", b"-"
_CLASS = np.full(256, len(_CLASSES), np.uint8)
for _k, _characters in enumerate(_CLASSES):
    _CLASS[list(_characters)] = _k
# Letters, digits, + and / are one group in a credential; in ordinary text small letters, capitals and digits are told apart.
_FORMAT_GROUPS = [0, 0, 0, 0, 0, 0, 0, 1, 2, 3, 4]
_PLAIN_GROUPS = [0, 0, 1, 1, 2, 3, 4, 5, 6, 7, 8]
_CAPITALS = bytes([2, 3, 2, 3, 4, 5, 6, 7, 8, 9, 10])
_NUMBERS = bytes([4, 4, 4, 4, 4, 5, 6, 7, 8, 9, 10])
_ALNUM = _CLASS < 5

# Kind, first characters, the other characters' alphabet, and their number, of common kinds of credentials.
CREDENTIALS = [
    ("assign", "", "A-Za-z0-9", 20),
    ("assign", "", "A-Za-z0-9", 32),
    ("assign", "", "A-Za-z0-9+/", 40),
    ("assign", "ghp_", "A-Za-z0-9", 36),
    ("access", "ASIA", "A-Z2-7", 16),
    ("hex", "", "A-F0-9", 32),
]
TABLE_ROWS = 400

# Ordinary words, for corpora without any in the sample.
ORDINARY = ["characteristics", "international", "responsibility", "Understanding", "self-sufficient", "high-performance"]
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True


def _assignments(whole: bytes, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(start, stop, value start, value stop) of matches, found from the sign in their middle."""
    signs = np.flatnonzero((data == ord("=")) | (data == ord(":")))
    texts = np.searchsorted(offsets, signs, "right")
    reached = 0
    for sign, low, high in zip(signs.tolist(), offsets[texts - 1].tolist(), offsets[texts].tolist(), strict=True):
        end = sign
        while end > low and whole[end - 1] == 0x20:
            end -= 1
        if end > low and whole[end - 1] in b"\"'":
            end -= 1
        before = whole[max(low, end - 8) : end].lower()
        keyword = next((k for k in _KEYWORDS if before.endswith(k)), None)
        if keyword is None or end - len(keyword) < reached:
            continue
        match = _VALUE.match(whole, sign + 1, high)
        if match:
            reached = match.end()
            yield end - len(keyword), match.end(), *match.span(1)


def base_spans(data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int]]:
    """(kind number, start, stop) in bytes of the slice."""
    whole, found = data.tobytes(), []
    for start, stop, low, high in _assignments(whole, data, offsets):
        if high - low >= 12:
            found.append((0, start, stop))
    at, reached = whole.find(b"AKIA"), 0
    while at >= 0:
        end = int(offsets[np.searchsorted(offsets, at, "right")])
        match = _ACCESS.match(whole, at, end) if at >= reached else None
        if match:
            reached = match.end()
            if match.end() - at >= 18:
                found.append((1, *match.span()))
        at = whole.find(b"AKIA", at + 1)
    starts, stops, _ = flat.split(data, offsets, _HEX[data])
    long = stops - starts >= 16
    return found + [(2, a, b) for a, b in zip(starts[long].tolist(), stops[long].tolist(), strict=True)]


def credential(first: str, alphabet: str, count: int, draw: random.Random) -> bytes:
    """A value of a format; the alphabet is written as the inside of a bracket expression of ranges."""
    among = [chr(c) for c in range(128) if re.match(f"[{alphabet}]", chr(c))]
    return (first + "".join(draw.choices(among, k=count))).encode()


def labelled_table(rows: int = TABLE_ROWS, seed: int = 1) -> list[tuple[int, list[bytes]]]:
    """(kind number, values) of each format of CREDENTIALS, the same in every run."""
    draw = random.Random(seed)
    return [(KINDS.index(kind), [credential(*form, draw) for _ in range(rows)]) for kind, *form in CREDENTIALS]


def _classes(value: bytes) -> bytes:
    return _CLASS[np.frombuffer(value, np.uint8)].tobytes()


def candidates(data: np.ndarray, offsets: np.ndarray, base: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of what may be a credential outside the base spans."""
    inside = _CLASS[data] < len(_CLASSES)
    sign = data == ord("=")
    inside[:-1] &= ~(sign[:-1] & inside[1:] & ~sign[1:])
    for _, a, b in base:
        inside[a:b] = False
    starts, ends, _ = flat.split(data, offsets, inside)
    long = ends - starts >= CANDIDATE_CHARS
    starts, ends = starts[long], ends[long]
    solid = np.flatnonzero(_ALNUM[data])
    low, high = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
    ends = ends[low < high]
    low, high = low[low < high], high[low < high]
    starts, stops = solid[low], solid[high - 1] + 1
    for _ in range(2):  # padding
        stops = stops + ((stops < ends) & sign[np.minimum(stops, len(data) - 1)])
    long = stops - starts >= CANDIDATE_CHARS
    return starts[long], stops[long]


class Formats:
    """An automaton and a threshold for each group of labelled values, and an automaton of ordinary runs if any are given."""

    def __init__(self, values: list[list[bytes]], more: list[tuple[int, list[bytes]]] = (), ordinary: list[bytes] = ()):
        self.models, self.ordinary = [], None
        if ordinary:
            runs = [_classes(run) for run in ordinary]
            runs += [run.translate(to.ljust(256)) for run in runs for to in (_CAPITALS, _NUMBERS)]
            self.ordinary = Automaton(runs, _PLAIN_GROUPS, restart=True)
        for kind, own in [*enumerate(values), *more]:
            if not own:
                continue
            text = np.frombuffer(b"".join(own), np.uint8)
            ends = np.cumsum([len(v) for v in own])
            model = Automaton([_classes(v) for v in own], _FORMAT_GROUPS)
            scores = np.sort(self._score(model, text, ends - [len(v) for v in own], ends))
            self.models.append((kind, model, scores[int(OUTLIERS * len(scores))]))

    @staticmethod
    def _score(model: Automaton, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        return model.likelihood(np.minimum(_CLASS[data], len(_CLASSES) - 1), starts, stops)

    def spans(self, data: np.ndarray, offsets: np.ndarray, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Candidates that an automaton accepts; of several kinds the likeliest."""
        starts, stops = candidates(data, offsets, base)
        if not len(starts) or not self.models:
            return []
        scores = np.stack([self._score(model, data, starts, stops) for _, model, _ in self.models])
        scores[scores < np.array([least for *_, least in self.models])[:, None]] = -np.inf
        best = scores.argmax(axis=0)
        plain = self._score(self.ordinary, data, starts, stops) if self.ordinary else -1e300
        accepted = np.flatnonzero(scores.max(axis=0) > plain)
        return [(self.models[best[k]][0], int(starts[k]), int(stops[k])) for k in accepted.tolist()]


def _least_hashed(values: set[bytes], most: int) -> list[bytes]:
    return sorted(values, key=lambda x: hashlib.md5(x).digest())[:most]


def labelled_values(texts: list[str], most: int = TRAIN_VALUES) -> list[list[bytes]]:
    """Values of each kind that the patterns find in the texts, at most `most` of a kind, in order."""
    data, offsets = flat.flat(pa.array(texts, pa.string()))
    whole = data.tobytes()
    values: list[set[bytes]] = [{whole[a:b] for _, _, a, b in _assignments(whole, data, offsets) if b - a >= 12}, set(), set()]
    for kind, a, b in base_spans(data, offsets):
        if kind:
            values[kind].add(whole[a:b])
    return [_least_hashed(v, most) for v in values]


def ordinary_runs(texts: list[str], most: int = ORDINARY_RUNS) -> list[bytes]:
    """What the patterns leave of the texts' candidates, with a few ordinary words."""
    data, offsets = flat.flat(pa.array([*texts, *ORDINARY], pa.string()))
    whole, (starts, stops) = data.tobytes(), candidates(data, offsets, base_spans(data, offsets))
    return _least_hashed({whole[a:b] for a, b in zip(starts.tolist(), stops.tolist(), strict=True)}, most)


def learned(docs: DataFrame, rows: int = TRAIN_ROWS) -> Formats:
    """Formats of the table and of at most `rows` documents that look like having secrets, none longer than TRAIN_CHARS."""
    looks = F.col("text").rlike("(?i:password|passwd|secret|token|api_?key)[\"']? *[:=]|AKIA[A-Z0-9]|[0-9a-f]{16}")
    texts = sampled_texts(docs, looks, rows, TRAIN_CHARS)
    return Formats(labelled_values(texts), labelled_table(), ordinary_runs(texts))


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{a}:{b}" for a, kind, b in sorted(spans))


_NOTHING = hashlib.sha256(b"").hexdigest()


def _find(batches: Iterator[pa.RecordBatch], formats: Formats) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in flat.slices(batches):
        n = len(offsets) - 1
        base = base_spans(data, offsets)
        extra = formats.spans(data, offsets, base)
        counts = np.zeros((n, len(KINDS)), np.int64)
        fixed: dict[int, list[tuple[int, int, int]]] = {}
        every: dict[int, list[tuple[int, int, int]]] = {}
        points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)]) if base or extra else None
        for spans, into in ((base, (fixed, every)), (extra, (every,))):
            for kind, a, b in spans:
                text = int(np.searchsorted(offsets, a, "right")) - 1
                origin = points[offsets[text]]
                for found in into:
                    found.setdefault(text, []).append((int(points[a] - origin), kind, int(points[b] - origin)))
        sha, texts, added = [_NOTHING] * n, [""] * n, np.zeros(n, np.int64)
        for text, own in every.items():
            first = fixed.get(text, [])
            np.add.at(counts[text], [kind for _, kind, _ in first], 1)
            sha[text], texts[text] = hashlib.sha256(_joined(first).encode()).hexdigest(), _joined(own)
            added[text] = len(own) - len(first)
        found = {f"n_{kind}": counts[:, k] for k, kind in enumerate(KINDS)}
        yield pa.RecordBatch.from_pydict(
            {"doc_id": rows.column("doc_id")} | found | {"base_sha256": sha, "spans": texts, "n_added": added}
        )


def secrets(docs: DataFrame, formats: Formats | None = None) -> DataFrame:
    """One row per row of `docs` (doc_id, text): counts of the base kinds, their digest, all spans, and how many are added.

    A null or empty text has no spans. A null doc_id stays null, equal rows stay equal rows, an empty table gives an empty
    result. Other columns are not read. Without formats they are learned from a sample of `docs` and the labelled table.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return docs.mapInArrow(partial(_find, formats=formats or learned(docs)), RESULT)
