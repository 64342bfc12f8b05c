"""Hard negatives by vertical scans with shrinking candidate sets (branch and bound on decomposed vectors).

Vectors are dealt into blocks, by label and leading dimension, that are stored column by column: a row per block and
dimension, with its least and greatest value. An anchor reads the columns of a block in the order of its own components, the
largest magnitudes first. After some columns every candidate has a partial score, and the least and the greatest that the
unread columns can add to it. Candidates that can't be among the best any more, or can't fall into one of the anchor's score
windows, leave the bitmap, and further columns are read for the others only. What is left has its exact score.

The ranges of a block's columns bound the scores of all its rows, too. An anchor first scans the block with the highest
bound; of the others it goes only to those whose bound reaches the k-th score found there. So an anchor travels to the
blocks that it has to see, and a block moves once.

There are two searches: for each anchor's positives among the rows of its label, and for the negatives of other labels, whose
score windows come from the positives. What blocks report, a few rows per anchor, is merged at the end.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lendframe.llm.files import partition
from lendframe.llm.tables import Store

SCALE, ANCHOR_STEP = 256, 50
POSITIVES, NEGATIVES = 5, 3
RELABEL_STEP, LABELS = 7, 10
LOW_PERCENT, HIGH_PERCENT = 50, 95
BLOCK, STRIDE = 1 << 12, 16

LEAST, GREATEST = -(1 << 63), (1 << 63) - 1
IDS, OWN, SUMMARY = -1, -2, -3  # rows of a block that are no dimension
COLUMNS = "block long, size int, dim int, data binary, label_low long, label_high long, lows array<long>, highs array<long>"
WINDOWS = "array<struct<window:int,low:long,high:long>>"
FOUND = "anchor_id long, window int, other_id long, score long"


def labelled_vectors(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, vector) of usable rows: every seventh id under the next label, floor(scale * x) of each component."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    usable = embeddings.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(fine, F.lit(False)))
    vec_id, label = F.col("vec_id").cast("long"), F.col("label").cast("long")
    label = F.when(vec_id % RELABEL_STEP == 0, (label + 1) % LABELS).otherwise(label)
    return usable.select(
        vec_id.alias("vec_id"), label.alias("label"), F.transform(x, lambda v: F.floor(v * scale).cast("long")).alias("vector")
    )


def _smallest(values: np.ndarray) -> bytes:
    """Integers as bytes, the first of which tells the width of the others."""
    for width in (2, 4):
        if not len(values) or (values.min() >= -(1 << (8 * width - 1)) and values.max() < 1 << (8 * width - 1)):
            return bytes([width]) + values.astype(f"<i{width}").tobytes()
    return bytes([8]) + values.astype("<i8").tobytes()


def _read(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<i{data[0]}", offset=1).astype(np.int64)


def _columns(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Sorted vectors as blocks of one length. A block ends at `rows` rows, or with its label once it is an eighth full."""
    number = partition() << 32
    for batch in batches:
        get = {c: batch.column(batch.schema.get_field_index(c)) for c in ("vec_id", "label", "size", "vector")}
        ids, labels, sizes = (get[c].to_numpy() for c in ("vec_id", "label", "size"))
        flat, ends = get["vector"].flatten().to_numpy(), np.concatenate([[0], np.cumsum(sizes)])
        runs = np.flatnonzero((sizes[1:] != sizes[:-1]) | (labels[1:] != labels[:-1])) + 1
        cuts = [0]
        for at in [*runs.tolist(), len(ids)]:
            while at - cuts[-1] > rows:
                cuts.append(cuts[-1] + rows)
            if at == len(ids) or sizes[at] != sizes[at - 1] or at - cuts[-1] >= rows // 8:
                cuts.append(at)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            size = int(sizes[a])
            columns = flat[ends[a] : ends[b]].reshape(b - a, size).T
            lows, highs = columns.min(axis=1).tolist(), columns.max(axis=1).tolist()
            data = [_smallest(x) for x in (*columns, ids[a:b], labels[a:b])]
            none = [None] * len(data)
            yield pa.RecordBatch.from_pydict(
                {
                    "block": pa.array([number] * (size + 3), pa.int64()),
                    "size": pa.array([size] * (size + 3), pa.int32()),
                    "dim": pa.array([*range(size), IDS, OWN, SUMMARY], pa.int32()),
                    "data": pa.array([*data, None], pa.binary()),
                    "label_low": pa.array([*none, int(labels[a:b].min())], pa.int64()),
                    "label_high": pa.array([*none, int(labels[a:b].max())], pa.int64()),
                    "lows": pa.array([*none, lows], pa.list_(pa.int64())),
                    "highs": pa.array([*none, highs], pa.list_(pa.int64())),
                }
            )
            number += 1


def in_columns(vectors: DataFrame, store: Store, rows: int = BLOCK) -> DataFrame:
    """The vectors in blocks, in order of length, label and the dimension of the greatest magnitude."""
    magnitudes = F.transform("vector", lambda v: F.abs(v))
    lead = F.coalesce(F.array_position(magnitudes, F.array_max(magnitudes)), F.lit(0))
    keyed = vectors.withColumn("size", F.size("vector")).withColumn("lead", lead)
    order = ["size", "label", "lead", "vec_id", "vector"]
    ordered = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    return store.keep(ordered.mapInArrow(partial(_columns, rows=rows), COLUMNS))


@dataclass
class Block:
    ids: np.ndarray
    labels: np.ndarray
    columns: np.ndarray  # a row per dimension
    lows: np.ndarray
    highs: np.ndarray

    @classmethod
    def of(cls, data: dict[int, bytes]) -> Block:
        ids, labels = _read(data[IDS]), _read(data[OWN])
        columns = [_read(data[d]) for d in range(len(data) - 2)]
        columns = np.stack(columns) if columns else np.zeros((0, len(ids)), np.int64)
        return cls(ids, labels, columns, columns.min(axis=1), columns.max(axis=1))


def scan(anchor: np.ndarray, block: Block, alive: np.ndarray, k: int, low: np.ndarray, high: np.ndarray) -> tuple:
    """(rows, scores): exact scores of the rows of the bitmap `alive` that may be among the k best of a window [low, high]
    of scores. The k best of every window are among them."""
    order = np.argsort(-np.abs(anchor), kind="stable")
    one, other = anchor * block.lows, anchor * block.highs
    least, most = np.minimum(one, other)[order], np.maximum(one, other)[order]
    # What the columns after the first i can add.
    least, most = (np.append(np.cumsum(x[::-1])[::-1], 0) for x in (least, most))
    rows = np.flatnonzero(alive)
    scores = np.zeros(len(rows), np.int64)
    lowest, highest = low.min(), high.max()
    for at in range(0, len(order), STRIDE):
        dims = order[at : at + STRIDE]
        part = block.columns[dims] if len(rows) == len(alive) else block.columns[np.ix_(dims, rows)]
        scores += (anchor[dims, None] * part).sum(axis=0)
        floor, top = scores + least[at + len(dims)], scores + most[at + len(dims)]
        kept = np.flatnonzero((top >= lowest) & (floor <= highest))
        # Each window by itself: who can't fall into it, or is beaten by k rows that surely do.
        floor, top, fits = floor[kept], top[kept], np.zeros(len(kept), bool)
        for lo, hi in zip(low, high, strict=True):
            own = (top >= lo) & (floor <= hi)
            sure = floor[(floor >= lo) & (top <= hi)]
            if len(sure) >= k:
                own &= top >= np.partition(sure, len(sure) - k)[len(sure) - k]
            fits |= own
        kept = kept[fits]
        if len(kept) < len(rows):
            rows, scores = rows[kept], scores[kept]
        if not len(rows):
            break
    return rows, scores


def _scans(batches: Iterator[pa.RecordBatch], k: int, same: bool) -> Iterator[pa.RecordBatch]:
    """Rows in order of blocks: first the columns of one, then the anchors that scan it."""
    data: dict[int, bytes] = {}
    block, number = None, None
    for batch in batches:
        get = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        numbers, anchors = get["block"].to_numpy(), get["anchor_id"]
        is_anchor = anchors.is_valid().to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(np.nan_to_num(get["vector"].value_lengths().to_numpy(zero_copy_only=False)))]).astype(int)
        vectors = get["vector"].flatten().to_numpy(zero_copy_only=False)
        out: tuple[list, ...] = ([], [], [], [])
        for i in range(batch.num_rows):
            if numbers[i] != number:
                data, block, number = {}, None, numbers[i]
            if not is_anchor[i]:
                data[get["dim"][i].as_py()] = get["data"][i].as_py()
                continue
            block = block or Block.of(data)
            own, label = anchors[i].as_py(), get["label"][i].as_py()
            alive = ((block.labels == label) if same else (block.labels != label)) & (block.ids != own)
            if not alive.any():
                continue
            windows = get["windows"][i].as_py()
            low, high = (np.array([w[c] for w in windows], np.int64) for c in ("low", "high"))
            rows, scores = scan(vectors[ends[i] : ends[i + 1]], block, alive, k, low, high)
            ids = block.ids[rows]
            for w, lo, hi in zip(windows, low, high, strict=True):
                fit = np.flatnonzero((scores >= lo) & (scores <= hi))
                best = fit[np.lexsort((ids[fit], -scores[fit]))[:k]]
                found = [own] * len(best), [w["window"]] * len(best), ids[best].tolist(), scores[best].tolist()
                for column, values in zip(out, found, strict=True):
                    column += values
        kinds = pa.int64(), pa.int32(), pa.int64(), pa.int64()
        names = [c.split()[0] for c in FOUND.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(out, kinds, strict=True)], names)


def _bound(vector: str, lows: str, highs: str) -> Column:
    """The highest inner product of a vector with anything between the lows and highs."""
    ends = F.zip_with(lows, highs, lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi")))
    most = F.zip_with(vector, ends, lambda v, e: v * F.when(v >= 0, e["hi"]).otherwise(e["lo"]))
    return F.aggregate(most, F.lit(0).cast("long"), lambda s, x: s + x)


def _scanned(asked: DataFrame, anchors: DataFrame, columns: DataFrame, k: int, same: bool) -> DataFrame:
    """What the scans of `asked` (anchor_id, block) find."""
    moved = asked.join(anchors.select("anchor_id", "label", "vector", "windows"), "anchor_id")
    held = columns.where(F.col("dim") != SUMMARY).select("block", "dim", "data")
    held = held.join(asked.select("block").distinct(), "block", "left_semi")
    rows = held.unionByName(moved, allowMissingColumns=True).repartition("block")
    rows = rows.sortWithinPartitions("block", F.col("anchor_id").asc_nulls_first())
    return rows.mapInArrow(partial(_scans, k=k, same=same), FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each window of each anchor with their rank; there are up to k rows a block."""
    order = W.partitionBy("anchor_id", "window").orderBy(F.desc("score"), "other_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(anchors: DataFrame, columns: DataFrame, k: int, same: bool, store: Store) -> DataFrame:
    """(anchor_id, window, other_id, score, rank): the k best rows, of the anchor's label or of others, in every window.

    `anchors` has anchor_id, label, size, vector, and windows of scores: (window, low, high).
    """
    summary = columns.where(F.col("dim") == SUMMARY).select("block", "size", "label_low", "label_high", "lows", "highs")
    salts = max(1, summary.count() // 32)
    summary = summary.withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int"))
    spread = anchors.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    spread = spread.withColumn("least", F.array_min(F.transform("windows", lambda w: w["low"])))
    allowed = F.col("label").between(F.col("label_low"), F.col("label_high"))
    if not same:
        allowed = (F.col("label_low") != F.col("label")) | (F.col("label_high") != F.col("label"))
    pairs = spread.join(summary, ["size", "salt"]).where(allowed)
    pairs = pairs.withColumn("bound", _bound("vector", "lows", "highs")).where("bound >= least")
    pairs = store.keep(pairs.select("anchor_id", "block", "bound"))

    # The best block of each anchor first; its k-th score is what other blocks have to reach.
    best = pairs.groupBy("anchor_id").agg(F.max_by("block", F.struct("bound", "block")).alias("block"))
    first = store.keep(_scanned(best, anchors, columns, k, same))
    worst = first.groupBy("anchor_id", "window").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("kth"))
    open_ = anchors.select("anchor_id", F.explode("windows").alias("w")).select("anchor_id", "w.window", "w.low")
    reach = F.when(F.col("n") >= k, F.col("kth")).otherwise(F.col("low"))
    needed = open_.join(worst, ["anchor_id", "window"], "left").groupBy("anchor_id").agg(F.min(reach).alias("needed"))
    rest = pairs.join(needed, "anchor_id").where("bound >= needed").select("anchor_id", "block")
    rest = store.keep(rest.join(best, ["anchor_id", "block"], "left_anti"))
    return _best(first.unionByName(_scanned(rest, anchors, columns, k, same)), k)


def hard_negatives(
    embeddings: DataFrame,
    scale: int = SCALE,
    step: int = ANCHOR_STEP,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    percent: tuple[int, int] = (LOW_PERCENT, HIGH_PERCENT),
    block: int = BLOCK,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are rows whose vec_id is divisible by `step`; their positives are the best rows of their label. The negatives of
    a pair are the best rows of other labels whose score lies between the two percentages of the positive's score. Scores
    are inner products of the integer vectors, ties go to the smaller id. Rows with a null id, label or vector, or with a
    null, NaN or infinite component, take no part; scores have to fit 64 bits. Vectors of different lengths are not compared.
    A row is no partner of an anchor of its own id; of repeated anchor rows one is asked (the smallest by label and vector); repeated other rows count
    each. Pairs without negatives have no row; an empty table gives an empty result. Other columns are not read.
    """
    store = Store(embeddings.sparkSession)
    vectors = store.keep(labelled_vectors(embeddings, scale))
    columns = in_columns(vectors, store, block)
    first = F.min(F.struct("label", "vector")).alias("v")
    anchors = vectors.where(F.col("vec_id") % step == 0).groupBy(F.col("vec_id").alias("anchor_id")).agg(first)
    anchors = store.keep(anchors.select("anchor_id", "v.label", "v.vector", F.size("v.vector").alias("size")))

    any_score = F.array(F.struct(F.lit(0).alias("window"), F.lit(LEAST).alias("low"), F.lit(GREATEST).alias("high")))
    found = search(anchors.withColumn("windows", any_score.cast(WINDOWS)), columns, positives, True, store)
    pairs = found.select("anchor_id", F.col("rank").alias("window"), F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score"))
    pairs = store.keep(pairs)

    # Integer scores between two hundredths of the positive's; below 0 the window is empty.
    low, high = (F.col("positive_score").cast("decimal(20,0)") * p / 100 for p in percent)
    window = F.struct("window", F.ceil(low).cast("long").alias("low"), F.floor(high).cast("long").alias("high"))
    windows = pairs.select("anchor_id", window.alias("w")).where("w.low <= w.high")
    windows = windows.groupBy("anchor_id").agg(F.array_sort(F.collect_list("w")).cast(WINDOWS).alias("windows"))
    found = search(store.keep(anchors.join(windows, "anchor_id")), columns, negatives, False, store)
    found = found.join(pairs, ["anchor_id", "window"])
    return found.select(
        "anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


SQL = """
WITH vectors AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, a.label = o.label AS same, o.vec_id AS other_id, list_inner_product(a.v, o.v)::BIGINT AS score
  FROM vectors a JOIN vectors o ON a.vec_id <> o.vec_id AND len(a.v) = len(o.v)
  WHERE a.vec_id % 50 = 0
), positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score
  FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
), negatives AS (
  SELECT p.anchor_id, p.positive_id, s.other_id AS negative_id, p.positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id)::INTEGER AS rank
  FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
  WHERE 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 3
"""
