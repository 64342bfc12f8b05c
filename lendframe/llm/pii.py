"""Personal data in texts: fixed patterns, and spans that a conditional random field over word shapes adds.

The field is trained on a small table of sentences labelled by hand (`pii_table.ROWS`), and on a bounded sample of the
documents, labelled by the patterns, from which it learns what is ordinary in them. So it finds data that miss a pattern, such
as a number with a wrong check digit or one without a country code. Spans it adds never overlap those of the patterns.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendframe.llm import flat, pii_table
from lendframe.llm.crf import Field, features, sequences
from lendframe.llm.tables import sampled_texts

KINDS = "email", "ip", "card", "phone"
TRAIN_ROWS, TRAIN_CHARS = 400, 20_000
TABLE_WEIGHT, TABLE_TURNS = 4, 5

RESULT = (
    "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
)

_DOMAIN = re.compile(rb"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match that fails from the head of a run of digits fails from inside it too.
_IP = re.compile(rb"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(rb"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")


def _set(characters: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(characters)] = True
    return table


_DIGITS = b"0123456789"
_DIGIT = _set(_DIGITS)
_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123))
_IN_EMAIL, _IN_IP, _IN_CARD = _set(_LETTERS + _DIGITS + b"._%+-@"), _set(_DIGITS + b"."), _set(_DIGITS + b" -")


def luhn(digits: bytes) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        d -= 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _small(part: bytes) -> bool:
    part = part.lstrip(b"0")
    return len(part) <= 3 and int(part or b"0") <= 255


def _runs(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, needed: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Runs of `inside` bytes that have `least` of the `needed` ones; a match of a pattern lies in one run."""
    starts, stops, _ = flat.split(data, offsets, inside)
    count = np.concatenate([[0], np.cumsum(needed, dtype=np.int32)])
    enough = count[stops] - count[starts] >= least
    return list(zip(starts[enough].tolist(), stops[enough].tolist(), strict=True))


def _emails(whole: bytes, a: int, b: int) -> Iterator[tuple[int, int]]:
    """Addresses in a run of address characters, in time linear in the run: before an @ stands all that the match before it
    and the last @ leave, so no start is tried twice."""
    end, at = a, whole.find(b"@", a, b)
    while at >= 0:
        match = _DOMAIN.match(whole, at + 1, b) if at > end else None
        if match:
            yield end, match.end()
        end = match.end() if match else at + 1
        at = whole.find(b"@", end, b)


def base_spans(data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int]]:
    """(kind number, start, stop) in bytes of the slice, by kind and then by start."""
    whole, found = data.tobytes(), []
    at, digit, dot = data == ord("@"), _DIGIT[data], data == ord(".")
    for a, b in _runs(data, offsets, _IN_EMAIL[data], at, 1) if at.any() else []:
        found += [(0, start, stop) for start, stop in _emails(whole, a, b)]
    for a, b in _runs(data, offsets, _IN_IP[data], dot & (np.roll(digit, 1) | np.roll(digit, -1)), 3):
        ips = [m for m in _IP.finditer(whole[a:b]) if all(map(_small, m.groups()))]
        found += [(1, a + m.start(), a + m.end()) for m in ips]
    for a, b in _runs(data, offsets, _IN_CARD[data], digit, 16):
        for m in _CARD.finditer(whole, a, b):
            digits = m[0].translate(None, b" -")
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append((2, *m.span()))
    plus = np.flatnonzero((data[:-1] == ord("+")) & digit[1:])
    ends = offsets[np.searchsorted(offsets, plus, "right")]
    for a, b in zip(plus.tolist(), ends.tolist(), strict=True):
        m = _PHONE.match(whole, a, b)
        if m and 8 <= sum(48 <= c <= 57 for c in m[0]) <= 15:
            found.append((3, *m.span()))
    return found


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and stops of words, the tokens that begin a sequence, and the feature rows."""
    starts, stops, first = flat.words(data, offsets)
    heads = sequences(data, starts, stops, first)
    return starts, stops, heads, features(data, starts, stops, heads)


def labelled(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature rows, sequence heads, tags) of texts, tagged by the patterns; sequences without a digit or @ are dropped."""
    data, offsets = flat.flat(pa.array(texts, pa.string()))
    starts, stops, heads, rows = tokens(data, offsets)
    tags = np.zeros(len(starts), np.int64)
    for kind, a, b in base_spans(data, offsets):
        tags[np.searchsorted(stops, a, "right") : np.searchsorted(starts, b)] = kind + 1
    marks = np.concatenate([[0], np.cumsum(_DIGIT[data] | (data == ord("@")))])
    lengths = np.diff(np.append(heads, len(starts)))
    last = stops[heads + lengths - 1]
    keep = marks[last] > marks[starts[heads]]
    chosen = np.repeat(keep, lengths)
    return rows[:, chosen], np.cumsum(lengths[keep]) - lengths[keep], tags[chosen]


def labelled_table(marked: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature rows, sequence heads, tags) of sentences with marks."""
    texts, marks = zip(*map(pii_table.unmarked, marked), strict=True)
    data, offsets = flat.flat(pa.array(texts, pa.string()))
    starts, stops, heads, rows = tokens(data, offsets)
    tags = np.zeros(len(starts), np.int64)
    for origin, own in zip(offsets, marks, strict=False):
        for kind, a, b in own:
            tags[np.searchsorted(stops, origin + a, "right") : np.searchsorted(starts, origin + b)] = KINDS.index(kind) + 1
    return rows, heads, tags


def fitted(texts: list[str], marked: list[str] = pii_table.ROWS, weight: int = TABLE_WEIGHT) -> Field:
    """A field of the marked sentences and of the texts as the patterns label them.

    The sentences come in TABLE_TURNS copies with exchanged values, each counted `weight` times.

    Sentences of the texts with an untagged word that has the shape of a word marked by itself are left out: there the
    patterns are no judge.
    """
    rows, heads, tags = labelled_table(pii_table.exchanged(marked, TABLE_TURNS))
    alone = (tags > 0) & (np.append(0, tags[:-1]) != tags) & (np.append(tags[1:], 0) != tags)
    parts = [(rows, heads, tags)] * weight
    own, begins, found = labelled(texts)
    if len(begins):
        lengths = np.diff(np.append(begins, len(found)))
        keep = ~np.logical_or.reduceat((found == 0) & np.isin(own[0], rows[0][alone]), begins)
        chosen = np.repeat(keep, lengths)
        parts.append((own[:, chosen], np.cumsum(lengths[keep]) - lengths[keep], found[chosen]))
    shifts = np.cumsum([0] + [len(t) for *_, t in parts[:-1]])
    field = Field(len(KINDS) + 1)
    field.train(
        np.concatenate([r for r, *_ in parts], axis=1),
        np.concatenate([h + shift for (_, h, _), shift in zip(parts, shifts, strict=True)]),
        np.concatenate([t for *_, t in parts]),
    )
    return field


def trained(docs: DataFrame, rows: int = TRAIN_ROWS) -> Field:
    """A field fitted to the table and at most `rows` documents with a digit, none longer than TRAIN_CHARS, chosen by a hash."""
    return fitted(sampled_texts(docs, F.col("text").rlike("[0-9]"), rows, TRAIN_CHARS))


def added_spans(
    data: np.ndarray, offsets: np.ndarray, field: Field, base: list[tuple[int, int, int]]
) -> list[tuple[int, int, int]]:
    """Runs of tokens with one tag that no base span touches, without punctuation at their ends but for a pair of brackets."""
    starts, stops, heads, rows = tokens(data, offsets)
    if not len(starts):
        return []
    tags = field.decode(rows, heads)
    begins = np.append(True, tags[1:] != tags[:-1])
    begins[heads] = True
    first = np.flatnonzero(begins)
    last = np.append(first[1:], len(tags)) - 1
    hit = tags[first] > 0
    taken = np.zeros(len(data), bool)
    for _, a, b in base:
        taken[a:b] = True
    covered = np.concatenate([[0], np.cumsum(taken, dtype=np.int32)])
    whole, found = data.tobytes(), []
    for tag, a, b in zip(tags[first[hit]].tolist(), starts[first[hit]].tolist(), stops[last[hit]].tolist(), strict=True):
        text = whole[a:b]
        a += len(text) - len(text.lstrip(_TRIM))
        b -= len(text) - len(text.rstrip(_TRIM))
        if whole.count(b")", a, b) > whole.count(b"(", a, b) and whole[a - 1 : a] == b"(":
            a -= 1  # a bracket that closes inside
        if a < b and covered[b] == covered[a]:
            found.append((tag - 1, a, b))
    return found


_TRIM = b".,;:!?\"'()[]{}<>|*#$%&"


def _ordered(spans: list[tuple[int, int, int]], data: np.ndarray, offsets: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
    """Spans of each text in code points of the text, by kind and then by start."""
    if not spans:
        return {}
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)])
    found: dict[int, list[tuple[int, int, int]]] = {}
    for kind, a, b in sorted(spans):
        text = int(np.searchsorted(offsets, a, "right")) - 1
        origin = points[offsets[text]]
        found.setdefault(text, []).append((kind, int(points[a] - origin), int(points[b] - origin)))
    return found


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{a}:{b}" for kind, a, b in spans)


_NOTHING = hashlib.sha256(b"").hexdigest()


def _find(batches: Iterator[pa.RecordBatch], field: Field) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in flat.slices(batches):
        n = len(offsets) - 1
        spans = base_spans(data, offsets)
        extra = added_spans(data, offsets, field, spans)
        base, every = _ordered(spans, data, offsets), _ordered(spans + extra, data, offsets)
        counts = np.zeros((n, len(KINDS)), np.int64)
        sha, texts, added = [_NOTHING] * n, [""] * n, np.zeros(n, np.int64)
        for text, own in every.items():
            fixed = base.get(text, [])
            np.add.at(counts[text], [kind for kind, _, _ in fixed], 1)
            sha[text], texts[text] = hashlib.sha256(_joined(fixed).encode()).hexdigest(), _joined(own)
            added[text] = len(own) - len(fixed)
        found = {f"n_{kind}": counts[:, k] for k, kind in enumerate(KINDS)}
        yield pa.RecordBatch.from_pydict(
            {"doc_id": rows.column("doc_id")} | found | {"base_sha256": sha, "spans": texts, "n_added": added}
        )


def personal_data(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """One row per row of `docs` (doc_id, text): counts of the base kinds, their digest, all spans, and how many are added.

    A null or empty text has no spans. A null doc_id stays null, equal rows stay equal rows, an empty table gives an empty
    result. Other columns are not read. Without a field one is trained on the labelled table and a sample of `docs`.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return docs.mapInArrow(partial(_find, field=field or trained(docs)), RESULT)


def _mask(batches: Iterator[pa.RecordBatch], field: Field) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in flat.slices(batches):
        spans = base_spans(data, offsets)
        spans += added_spans(data, offsets, field, spans)
        whole, texts = data.tobytes(), {}
        for kind, a, b in sorted(spans, key=lambda s: s[1:]):
            text = int(np.searchsorted(offsets, a, "right")) - 1
            parts, upto = texts.get(text, ([], int(offsets[text])))
            if b > upto:  # kinds may overlap: what is masked already stays so
                parts += [whole[upto : max(a, upto)], f"<{KINDS[kind].upper()}>".encode()] if a >= upto else []
                texts[text] = parts, b
        new = {t: b"".join([*parts, whole[upto : offsets[t + 1]]]).decode() for t, (parts, upto) in texts.items()}
        column = rows.column("text")
        if new:
            column = pa.array([new.get(t, v) for t, v in enumerate(column.to_pylist())], column.type)
        at = rows.schema.get_field_index("text")
        yield pa.RecordBatch.from_arrays([*rows.columns[:at], column, *rows.columns[at + 1 :]], schema=rows.schema)


def masked_documents(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """The rows of `docs` with the name of its kind in place of every span; all other columns stay."""
    return docs.mapInArrow(partial(_mask, field=field or trained(docs)), docs.schema)
