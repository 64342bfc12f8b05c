"""Quality rules: surface counts of a text, and a hashed n-gram log-likelihood ratio against the raw corpus.

Words and word pairs of lower-cased texts are hashed into buckets, as many as the corpus needs to have at most `LOAD` n-grams
in one on average. Bucket counts over trusted documents and over all documents give two smoothed multinomials. A text's
score is the sum over its n-grams of log(p_trusted / p_raw), divided by the number of n-grams; its own n-grams are taken out
of both counts first, so that trusted texts have no advantage. Texts that score below nearly all trusted ones, by more than
a margin that follows the spread of the trusted scores, are rejected.

Raw counts come from every document, trusted counts and the threshold from all that the labels trust. Ids meet documents by
a shuffle join, which the texts go through once for the counts. The bucket table lies in the shared folder in parts of `PART`
buckets, added up by one task each from what the tasks have counted and packed. The driver knows their names only. A worker
reads the parts that its texts ask for and holds up to `HELD` of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendframe.functions.grouped import HotRule, number_rows
from lendframe.llm import flat
from lendframe.llm.files import new_file, open_file
from lendframe.llm.tables import Store

LOAD, FEWEST = 512, 1 << 14  # n-grams to a bucket, and buckets of a small corpus
PART, HELD = 1 << 16, 512  # buckets of a part (half a MB), and parts that a worker holds
COUNTED, MERGED = 1 << 20, 1 << 21  # n-grams that a task holds before it adds them up, and sums before it packs them
SLICE = 1 << 20  # bytes of texts that a task works on at a time
CHUNKED = HotRule(10_000)  # scores that one task may put in order
OUTLIERS, MARGIN = 0.001, 1.0  # the threshold is this quantile of the trusted scores, less so many interquartile ranges
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True

SCORED = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, score double, own_score double"
)
RESULT = "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur more than once."""
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    return twice[at] == keys


def surface(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The base counts of each text."""
    texts = len(offsets) - 1
    starts, stops, first = flat.words(data, offsets)
    of_word = flat.owner(first)
    n_words = np.diff(first)
    begins = (data & 0xC0) != 0x80
    points = np.concatenate([[0], np.cumsum(begins, dtype=np.int64)])
    chars = np.bincount(of_word, points[stops] - points[starts], texts).astype(np.int64)

    salt = flat.mix(np.arange(texts, dtype=np.uint64))
    keys, where = flat.windows(flat.hashes(data, starts, stops), first, 3)
    twice = where[repeated(keys ^ salt[of_word[where]])] if len(where) else where
    covered = np.zeros(len(starts) + 3, bool)
    for k in range(3):
        covered[twice + k] = True
    repeats = np.bincount(of_word, covered[: len(starts)], texts).astype(np.int64)

    line_starts, line_stops, line_first = flat.lines(data, offsets)
    with_word = np.searchsorted(starts, line_stops) > np.searchsorted(starts, line_starts)
    of_line = flat.owner(line_first)[with_word]
    line_keys = flat.hashes(data, line_starts, line_stops)[with_word] ^ salt[of_line]
    ordered = np.argsort(line_keys, kind="stable")
    again = ordered[1:][line_keys[ordered[1:]] == line_keys[ordered[:-1]]]
    return {
        "n_words": n_words,
        "word_chars": chars,
        "n_symbols": flat.per_text(_SYMBOL[data], offsets),
        "n_dup_lines": np.bincount(of_line[again], minlength=texts),
        "n_repeat_words": repeats,
    }


def grams(data: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and word pairs, and the text of each."""
    low = flat.LOWER[data]
    starts, stops, first = flat.words(low, offsets)
    hashed = flat.hashes(low, starts, stops)
    pairs, where = flat.windows(hashed, first, 2)
    of_word = flat.owner(first)
    keys = np.concatenate([flat.mix(hashed), pairs])
    return (keys % np.uint64(buckets)).astype(np.int64), np.concatenate([of_word, of_word[where]])


def bucket_count(n_grams: int) -> int:
    """The power of two that leaves at most `LOAD` n-grams to a bucket."""
    return max(FEWEST, 1 << (max(1, -(-n_grams // LOAD)) - 1).bit_length())


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = 0
    for _, data, offsets in flat.slices(batches, limit=SLICE):
        n_words = np.diff(flat.words(data, offsets)[2])
        n += int(np.maximum(2 * n_words - 1, 0).sum())
    yield pa.RecordBatch.from_pydict({"n": [n]})


def _packed(values: np.ndarray) -> bytes:
    """Small numbers as compressed byte planes."""
    planes = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return pa.Codec("zstd").compress(planes.tobytes(), asbytes=True)


def _unpacked(packed: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.Codec("zstd").decompress(packed, 4 * n, asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view("<u4").ravel().astype(np.int64)


def _merged(marked: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of equal keys added up, in the order of the keys."""
    order = np.argsort(marked, kind="stable")
    marked, n = marked[order], n[order]
    heads = np.flatnonzero(np.append(True, marked[1:] != marked[:-1]))
    return marked[heads], np.add.reduceat(n, heads)


def _part_counts(marked: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Counts of buckets, given as how often each 2 * bucket + trusted occurs, in order: a row for each part that has some."""
    buckets = marked >> 1
    first = np.flatnonzero(np.append(True, buckets[1:] != buckets[:-1]))
    raw, trusted = np.add.reduceat(n, first), np.add.reduceat(n * (marked & 1), first)
    buckets = buckets[first]
    cuts = np.flatnonzero(np.append(True, buckets[1:] // PART != buckets[:-1] // PART))
    spans = list(zip(cuts, np.append(cuts[1:], len(buckets)), strict=True))
    return pa.RecordBatch.from_pydict(
        {
            "part": pa.array(buckets[cuts] // PART, pa.int32()),
            "n": pa.array([b - a for a, b in spans], pa.int32()),
            "steps": [_packed(np.diff(buckets[a:b], prepend=buckets[a] // PART * PART)) for a, b in spans],
            "raw": [_packed(raw[a:b]) for a, b in spans],
            "trusted": [_packed(trusted[a:b]) for a, b in spans],
        }
    )


COUNTS = "part int, n int, steps binary, raw binary, trusted binary"


def _count(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    sums, held, n = (np.empty(0, np.int64), np.empty(0, np.int64)), [], 0

    def added() -> tuple[np.ndarray, np.ndarray]:
        keys, times = np.unique(np.concatenate(held), return_counts=True)
        return _merged(np.concatenate([sums[0], keys]), np.concatenate([sums[1], times]))

    for rows, data, offsets in flat.slices(batches, limit=SLICE):
        keys, of = grams(data, offsets, buckets)
        held.append(2 * keys + _chosen(rows, "trusted")[of])
        n += len(keys)
        if n >= COUNTED:
            sums, held, n = added(), [], 0
            if len(sums[0]) >= MERGED:
                yield _part_counts(*sums)
                sums = np.empty(0, np.int64), np.empty(0, np.int64)
    if n:
        sums = added()
    if len(sums[0]):
        yield _part_counts(*sums)


TABLE = "part int, uri string, raw long, trusted long"


def _add_up(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """Writes the table of each part; rows come in order of their parts."""

    def done(part: int, table: np.ndarray) -> pa.RecordBatch:
        uri, stream = new_file(folder, ".counts")
        with stream:
            stream.write(table.astype("<f4").tobytes())
        row = {"part": pa.array([part], pa.int32()), "uri": [uri], "raw": [int(table[0].sum())], "trusted": [int(table[1].sum())]}
        return pa.RecordBatch.from_pydict(row)

    now, table = None, None
    for batch in batches:
        for row in range(batch.num_rows):
            part, n, *packed = (batch.column(i)[row].as_py() for i in range(5))
            if part != now:
                if now is not None:
                    yield done(now, table)
                now, table = part, np.zeros((2, PART), np.int64)
            steps, raw, trusted = (_unpacked(p, n) for p in packed)
            at = np.cumsum(steps)
            table[0, at] += raw
            table[1, at] += trusted
    if now is not None:
        yield done(now, table)


@lru_cache(HELD)
def _table(uri: str) -> np.ndarray:
    """Raw and trusted counts of one part. Above 2**24 they are rounded to 24 bits."""
    with open_file(uri) as stream:
        return np.frombuffer(stream.read(), "<f4").reshape(2, -1)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """All documents that every label calls good and none calls toxic."""
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    return good.where("doc_id IS NOT NULL AND quality = 1 AND toxic = 0").select("doc_id")


@dataclass
class Counts:
    """What is known of one kind of counts without reading the table."""

    total: int = 0

    def sum(self) -> int:
        return self.total

    def any(self) -> bool:
        return self.total > 0


@dataclass
class Model:
    buckets: int
    parts: dict[int, str]
    raw: Counts
    trusted: Counts
    threshold: float = -np.inf

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """Raw and trusted counts of buckets, as two rows."""
        of_part = keys // PART
        order = np.argsort(of_part, kind="stable")
        cuts = np.searchsorted(of_part, np.arange(-(-self.buckets // PART) + 1), sorter=order)
        found = np.zeros((2, len(keys)))
        for part, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if a < b and part in self.parts:
                at = order[a:b]
                found[:, at] = _table(self.parts[part])[:, keys[at] % PART]
        return found

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Length-normalised log-likelihood ratio of each text, and what it is if the trusted counts contain the text."""
        texts, buckets = len(offsets) - 1, self.buckets
        if not self.trusted.any():
            return np.zeros(texts), np.zeros(texts)
        keys, of = grams(data, offsets, buckets)
        both, own = np.unique(of * buckets + keys, return_counts=True)
        of, keys = both // buckets, both % buckets
        size = np.bincount(of, own, texts)
        raw, trusted = self.counts(keys)
        raw = (np.maximum(raw - own, 0) + 1) / (np.maximum(self.raw.sum() - size, 0) + buckets)[of]

        def score(mine: np.ndarray, less: np.ndarray) -> np.ndarray:
            good = (np.maximum(trusted - mine, 0) + 1) / (self.trusted.sum() - less + buckets)[of]
            return np.bincount(of, own * np.log(good / raw), texts) / np.maximum(size, 1)

        none = np.zeros(texts)
        return score(none[of], none), score(own, np.minimum(size, self.trusted.sum()))


def _flagged(docs: DataFrame, chosen: DataFrame) -> tuple[DataFrame, str]:
    """`docs` with a column, of a name it has not in any case of letters, that is true for the chosen ids."""
    name, used = "trusted", {c.lower() for c in docs.columns}
    while {name, f"{name}id"} & used:
        name += "_"
    ids = chosen.select(F.col("doc_id").alias(f"{name}id"), F.lit(True).alias(name))
    # A broadcast would grow with the labels, and needs of disk would jump where it no longer fits.
    return docs.join(ids.hint("merge"), docs["doc_id"] == ids[f"{name}id"], "left").drop(f"{name}id"), name


def counted(docs: DataFrame, labels: DataFrame, buckets: int | None = None) -> Model:
    """Counts over all of `docs` and over its trusted rows, without a threshold."""
    store = Store(docs.sparkSession)
    if buckets is None:
        buckets = bucket_count(docs.select("text").mapInArrow(_sizes, "n long").agg(F.sum("n")).first()[0] or 0)
    flagged, _ = _flagged(docs.select("doc_id", "text"), trusted_ids(labels))
    counts = flagged.mapInArrow(partial(_count, buckets=buckets), COUNTS)
    counts = counts.repartition("part").sortWithinPartitions("part")
    table = counts.mapInArrow(partial(_add_up, folder=store.folder), TABLE).collect()  # one row per part
    totals = (Counts(sum(r[name] for r in table)) for name in ("raw", "trusted"))
    return Model(buckets, {r.part: r.uri for r in table}, *totals)


def scored(docs: DataFrame, labels: DataFrame, model: Model) -> DataFrame:
    """RESULT without `kept`, and `trusted`, of every row of `docs`; written below the shared folder.

    A text is scored both as a trusted one and as another; the ids choose between the two afterwards, without the texts.
    """
    both, _ = _flagged(docs.mapInArrow(partial(_judge, model=model), SCORED), trusted_ids(labels))
    score = F.when(F.col("trusted"), F.col("own_score")).otherwise(F.col("score"))
    return Store(docs.sparkSession).keep(both.withColumn("score", score).drop("own_score"))


def quantiles(df: DataFrame, column: str, shares: tuple[float, ...]) -> list[float] | None:
    """What `percentile` gives, without all values in one task: the places of the sorted rows that it lies between."""
    at = [(df.count() - 1) * share for share in shares]
    if at[0] < 0:
        return None
    places = {int(f(x)) + 1 for x in at for f in (np.floor, np.ceil)}
    there = number_rows(df.select(column), column, "place", CHUNKED).where(F.col("place").isin(sorted(places)))
    value = {r["place"] - 1: r[column] for r in there.collect()}
    ends = [(x, int(np.floor(x)), int(np.ceil(x))) for x in at]
    return [value[a] if value[a] == value[b] else (b - x) * value[a] + (x - a) * value[b] for x, a, b in ends]


def threshold(found: DataFrame) -> float:
    """The least score to keep, from the scores of all trusted texts that the base rule passes."""
    marks = quantiles(found.where("trusted AND NOT base_failed"), "score", (OUTLIERS, 0.25, 0.75))
    return -np.inf if marks is None else marks[0] - MARGIN * (marks[2] - marks[1])


def fitted(docs: DataFrame, labels: DataFrame, buckets: int | None = None) -> Model:
    """Counts over all of `docs` and over its trusted rows, and the threshold that the trusted rows give."""
    model = counted(docs, labels, buckets)
    if model.trusted.any():
        model.threshold = threshold(scored(docs.select("doc_id", "text"), labels, model))
    return model


def base_failed(counts: dict[str, np.ndarray]) -> np.ndarray:
    return (counts["n_words"] < MIN_WORDS) | (100 * counts["n_repeat_words"] > MAX_REPEAT_PERCENT * counts["n_words"])


def _chosen(rows: pa.RecordBatch, name: str) -> np.ndarray:
    return np.asarray(rows.column(name).fill_null(False)).astype(bool)


def _judge(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in flat.slices(batches, limit=SLICE):
        found = surface(data, offsets)
        score, own_score = model.scores(data, offsets)
        found |= {"base_failed": base_failed(found), "score": score, "own_score": own_score}
        yield pa.RecordBatch.from_pydict({"doc_id": rows.column("doc_id")} | found)


def _keep(batches: Iterator[pa.RecordBatch], model: Model, name: str) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in flat.slices(batches, limit=SLICE):
        score = np.where(_chosen(rows, name), *model.scores(data, offsets)[::-1])
        kept = rows.filter(pa.array(~base_failed(surface(data, offsets)) & (score >= model.threshold)))
        yield kept.select([c for c in kept.schema.names if c != name])


def quality(docs: DataFrame, labels: DataFrame, buckets: int | None = None) -> DataFrame:
    """One row per row of `docs` (doc_id, text): base counts, score and verdict.

    A null or empty text has no words and fails the base rule; a null doc_id stays a row of its own with a null id, equal
    rows stay equal rows, an empty table gives an empty result. Other columns are not read, whatever their names. Without
    trusted documents every score is 0 and only the base rule decides.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    model = counted(docs, labels, buckets)
    found = scored(docs, labels, model)
    least = threshold(found) if model.trusted.any() else -np.inf
    kept = ~F.col("base_failed") & (F.col("score") >= F.lit(float(least)))
    return found.withColumn("kept", kept).select(*RESULT)


def kept_documents(docs: DataFrame, labels: DataFrame, buckets: int | None = None) -> DataFrame:
    """The rows of `docs` that `quality` keeps, with all their columns; each row is judged by its own text."""
    flagged, name = _flagged(docs, trusted_ids(labels))
    return flagged.mapInArrow(partial(_keep, model=fitted(docs, labels, buckets), name=name), docs.schema)
