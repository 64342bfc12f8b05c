"""Passages that documents share, from a sparse suffix array.

1. Suffixes are kept where a text's own content says so: at the smallest 16-word hash of every run of as many of them as a
   passage of `least` words has. Two copies of a passage thus keep the same suffixes, at least one each.
2. Only suffixes whose first 16 words occur in two different texts go on. They are sorted by the words that follow, then by
   the words before them read backwards, and once more the other way round, over range partitions: a very common passage is
   spread over many tasks.
3. Neighbours in this order are compared: the match is extended to the right and to the left word by word. It counts if it
   has `least` words. Spans of one document that overlap are one passage, so that passages of any length come out whole.

Texts that are equal as a whole are found by their hash and go into the array once.

A suffix is compared with the nearest ones of another text and `NEIGHBOURS` more in both orders. Of all suffixes the nearest
shares most on the side that is sorted first, so the two orders tell how far a match can reach on each side at the most.
Where no compared neighbour reaches both ends, another suffix that shares less on each side may still share a passage: the
suffixes of such keys are settled by the hashes of all windows of `least` words around them, counted without pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lendframe.llm import flat
from lendframe.llm.files import partition
from lendframe.llm.mixing import word_count
from lendframe.llm.tables import Store

LEAST_WORDS, GRAM, NEIGHBOURS = 50, 16, 4
SLOTS, HOT_ROWS, SALTS = 1 << 20, 20_000, 64
_AFTER = ["after", "before"]

ANCHOR = "key long, text_hash long, doc_id long, place int"
SUFFIX = "key long, after binary, before binary, text_hash long, doc_id long, place int"
FOUND = "doc_id long, start int, stop int, other_doc_id long, part int, turn int, " + SUFFIX.replace("doc_id", "own_id")
FOUND += ", reach int, best int"
WINDOW = "window long, doc_id long, start int"


def _sliding(values: np.ndarray, size: int, best: np.ufunc) -> np.ndarray:
    """best(values[i], ..., values[i + size - 1]) for every i that has so many."""
    done, width = values, 1
    while width * 2 <= size:
        done, width = best(done[:-width], done[width:]), width * 2
    rest = size - width
    return best(done[: len(done) - rest], done[rest:]) if rest else done


def minimisers(hashed: np.ndarray, first: np.ndarray, gram: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, word numbers) of the grams that are smallest in some run of `least` words inside one text."""
    size = least - gram + 1
    if len(hashed) < least:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    grams, where = flat.windows(hashed, first, gram)
    values = np.full(len(hashed), np.iinfo(np.uint64).max, np.uint64)
    values[where] = grams
    smallest = _sliding(values, size, np.minimum)
    # Runs that would leave their text don't count.
    ends = np.repeat(first[1:], np.diff(first))
    smallest[np.arange(len(smallest)) + least > ends[: len(smallest)]] = 0
    padded = np.concatenate([np.zeros(size - 1, np.uint64), smallest, np.zeros(size - 1, np.uint64)])
    chosen = np.flatnonzero(_sliding(padded, size, np.maximum)[: len(values)] == values)
    chosen = chosen[values[chosen] != np.iinfo(np.uint64).max]
    return values[chosen], chosen


def _anchors(batches: Iterator[pa.RecordBatch], gram: int, least: int) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in flat.slices(batches):
        starts, stops, first = flat.words(data, offsets)
        keys, chosen = minimisers(flat.hashes(data, starts, stops), first, gram, least)
        of = flat.owner(first)[chosen]
        yield pa.RecordBatch.from_pydict(
            {
                "key": keys.view(np.int64),
                "text_hash": rows.column("text_hash").to_numpy()[of],
                "doc_id": rows.column("doc_id").to_numpy()[of],
                "place": (chosen - first[of]).astype(np.int32),
            }
        )


def _suffixes(batches: Iterator[pa.RecordBatch], gram: int, least: int) -> Iterator[pa.RecordBatch]:
    """A row for each place of a text, with the words around it as hashes; 0 stands for no word."""
    reach = least - gram
    kind = pa.binary(4 * reach)
    for rows, data, offsets in flat.slices(batches):
        starts, stops, first = flat.words(data, offsets)
        hashed = (flat.hashes(data, starts, stops) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        column = rows.column("places").combine_chunks() if isinstance(rows.column("places"), pa.ChunkedArray) else rows.column("places")
        of = np.repeat(np.arange(len(column)), column.value_lengths().to_numpy())
        places = column.flatten()
        place, key = places.field("place").to_numpy(), places.field("key").to_numpy()
        for a in range(0, len(of), 1 << 14):
            own, here = of[a : a + (1 << 14)], place[a : a + (1 << 14)]
            at = first[own] + here
            after = at[:, None] + gram + np.arange(reach)
            before = at[:, None] - 1 - np.arange(reach)
            right = np.where(after < first[own + 1][:, None], hashed[np.minimum(after, len(hashed) - 1)], 0)
            left = np.where(before >= first[own][:, None], hashed[np.maximum(before, 0)], 0)
            yield pa.RecordBatch.from_pydict(
                {
                    "key": key[a : a + (1 << 14)],
                    "after": pa.Array.from_buffers(kind, len(own), [None, pa.py_buffer(right.astype(">u4").tobytes())]).cast(pa.binary()),
                    "before": pa.Array.from_buffers(kind, len(own), [None, pa.py_buffer(left.astype(">u4").tobytes())]).cast(pa.binary()),
                    "text_hash": rows.column("text_hash").to_numpy()[own],
                    "doc_id": rows.column("doc_id").to_numpy()[own],
                    "place": here.astype(np.int32),
                }
            )


def _matrix(column: pa.Array) -> np.ndarray:
    """Equally long binary values as rows of word hashes."""
    width = len(column[0].as_py()) if len(column) else 4
    fixed = column.cast(pa.binary(width))
    _, data = fixed.buffers()
    return np.frombuffer(data, ">u4")[fixed.offset * width // 4 :][: len(fixed) * width // 4].reshape(len(fixed), -1)


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many leading words two rows share."""
    differs = (a != b) | (a == 0)
    return np.where(differs.any(axis=1), differs.argmax(axis=1), a.shape[1])


def _neighbours(batches: Iterator[pa.RecordBatch], gram: int, least: int, first: str) -> Iterator[pa.RecordBatch]:
    """Spans of sorted suffixes that match a neighbour, the first and last rows of the partition themselves, and for every
    suffix of a crowded key how far matches reach on the side sorted first, and on both sides with one neighbour."""
    schema = pa.schema(
        [("doc_id", pa.int64()), ("start", pa.int32()), ("stop", pa.int32()), ("other_doc_id", pa.int64()),
         ("part", pa.int32()), ("turn", pa.int32()), ("key", pa.int64()), ("after", pa.binary()), ("before", pa.binary()),
         ("text_hash", pa.int64()), ("own_id", pa.int64()), ("place", pa.int32()), ("reach", pa.int32()), ("best", pa.int32())]
    )
    names = ["key", "after", "before", "text_hash", "doc_id", "place"]
    number = partition()

    def edge(table: pa.Table, turn: int) -> pa.RecordBatch:
        n = table.num_rows
        none = [pa.nulls(n, schema.field(i).type) for i in range(4)]
        marks = [pa.array([number] * n, pa.int32()), pa.array(range(turn, turn + n), pa.int32())]
        columns = [table.column(name).combine_chunks() for name in names]
        return pa.RecordBatch.from_arrays([*none, *marks, *columns, *[pa.nulls(n, pa.int32())] * 2], schema=schema)

    tail = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch]).select(names)
        fresh = tail is None
        table = table if fresh else pa.concat_tables([tail, table]).combine_chunks()
        n = table.num_rows
        key, text, ids = (table.column(c).to_numpy() for c in ("key", "text_hash", "doc_id"))
        place = table.column("place").to_numpy()
        # Runs of one text: a text that repeats itself must not keep the others away from each of its suffixes.
        heads = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (text[1:] != text[:-1])))
        stops = np.append(heads[1:], n)
        sizes = stops - heads
        above, below = np.repeat(heads - 1, sizes), np.repeat(stops, sizes)
        every = np.arange(n)
        pairs = [(every, above), (every, below), *((every, every + step) for step in range(1, NEIGHBOURS + 1))]
        i, j = (np.concatenate(c) for c in zip(*pairs, strict=True))
        inside = (j >= 0) & (j < n)
        i, j = i[inside], j[inside]
        fit = (key[i] == key[j]) & (text[i] != text[j])
        i, j = i[fit], j[fit]
        after, before = (_matrix(table.column(c).combine_chunks()) for c in ("after", "before"))
        right, left = common(after[i], after[j]), common(before[i], before[j])
        fit = ids[i] != ids[j]
        reach, best = np.zeros(n, np.int32), np.zeros(n, np.int32)
        for side in (i, j):
            np.maximum.at(reach, side, right if first == "after" else left)
            np.maximum.at(best, side[fit], (right + left)[fit])
        # Groups that end inside this table and have no more rows than are compared with each other are done.
        groups = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        sizes_of = np.diff(np.append(groups, n))
        crowded = sizes_of > NEIGHBOURS + 1
        crowded[[0, -1]] = True
        told = np.flatnonzero(np.repeat(crowded, sizes_of))
        blank = [pa.nulls(len(told), schema.field(c).type) for c in range(6)]
        held = [pa.array(key[told]), *[pa.nulls(len(told), pa.binary())] * 2, pa.array(text[told]), pa.array(ids[told]), pa.array(place[told])]
        yield pa.RecordBatch.from_arrays([*blank, *held, pa.array(reach[told]), pa.array(best[told])], schema=schema)
        i, j, right, left = i[fit], j[fit], right[fit], left[fit]
        long = gram + right + left >= least
        i, j, right, left = i[long], j[long], right[long], left[long]
        x, y = np.concatenate([i, j]), np.concatenate([j, i])
        right, left = np.tile(right, 2), np.tile(left, 2)
        # The same span of a document is told once, with the smallest other document.
        start, stop = place[x] - left, place[x] + gram + right
        order = np.lexsort((ids[y], stop, start, ids[x]))
        x, y, start, stop = x[order], y[order], start[order], stop[order]
        new = np.append(True, (ids[x[1:]] != ids[x[:-1]]) | (start[1:] != start[:-1]) | (stop[1:] != stop[:-1]))[: len(x)]
        x, y, start, stop = x[new], y[new], start[new], stop[new]
        found = [pa.array(ids[x]), pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32)), pa.array(ids[y])]
        yield pa.RecordBatch.from_arrays(found + [pa.nulls(len(x), f.type) for f in list(schema)[4:]], schema=schema)
        if fresh:
            yield edge(table.slice(0, int(stops[0]) + NEIGHBOURS), 0)
        tail = table.slice(max(0, int(heads[-1]) - NEIGHBOURS))
    if tail is not None:
        yield edge(tail, 1 << 30)


def merged_spans(spans: DataFrame) -> DataFrame:
    """Overlapping spans (doc_id, start, stop, other_doc_id) of a document as one, with the other document of the longest
    of them, the smallest of equals, and how many words that span has (n_shared)."""
    order = W.partitionBy("doc_id").orderBy("start", "stop")  # at most some rows per word of one document
    reach = F.max("stop").over(order.rowsBetween(W.unboundedPreceding, -1))
    opens = F.when(F.coalesce(F.col("start") > reach, F.lit(True)), 1).otherwise(0)
    marked = spans.withColumn("opens", opens).withColumn("island", F.sum("opens").over(order))
    longest = F.min(F.struct((F.col("start") - F.col("stop")).alias("less"), "other_doc_id")).alias("longest")
    islands = marked.groupBy("doc_id", "island").agg(F.min("start").alias("start_word"), F.max("stop").alias("end_word"), longest)
    return islands.select("doc_id", "start_word", "end_word", (-F.col("longest.less")).alias("n_shared"), "longest.other_doc_id")


def _sorted_matches(suffixes: DataFrame, store: Store, order: list[str], sizes: dict[str, int]) -> DataFrame:
    ordered = suffixes.repartitionByRange(*order).sortWithinPartitions(*order, "doc_id", "place")
    compare = partial(_neighbours, **sizes, first=order[1])
    found = store.keep(ordered.mapInArrow(compare, FOUND))
    # Neighbours on both sides of a partition's end: some rows of each partition.
    edges = found.where("part IS NOT NULL").repartition(1).sortWithinPartitions("part", "turn")
    edges = edges.withColumn("doc_id", F.col("own_id")).select(*order, "text_hash", "doc_id", "place")
    return found.unionByName(store.keep(edges.mapInArrow(compare, FOUND)))


def _slot(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(SLOTS)).cast("int").alias("slot")


def _slots(keys: DataFrame, key: str) -> DataFrame:
    """The slots of some keys: at most SLOTS rows, so they can be broadcast."""
    return F.broadcast(keys.select(_slot(key)).distinct())


def _windows(batches: Iterator[pa.RecordBatch], gram: int, least: int) -> Iterator[pa.RecordBatch]:
    """The hash of every window of `least` words around each suffix, and where it begins."""
    reach = least - gram
    turns = flat.weights(2 * reach + 1)[: 2 * reach + 1]
    for batch in batches:
        get = {name: batch.column(batch.schema.get_field_index(name)) for name in ("key", "after", "before", "doc_id", "place")}
        for a in range(0, batch.num_rows, 1 << 13):
            part = {name: column.slice(a, 1 << 13) for name, column in get.items()}
            sums, there = [], []
            for side, name in enumerate(("after", "before")):
                words = _matrix(part[name]).astype(np.uint64)
                terms = flat.mix(words) * turns[side * reach : (side + 1) * reach]
                total = np.cumsum(terms, axis=1, dtype=np.uint64)
                sums.append(np.concatenate([np.zeros((len(words), 1), np.uint64), total], axis=1))
                there.append((words != 0).sum(axis=1))
            key = flat.mix(part["key"].to_numpy().view(np.uint64))
            for r in range(reach + 1):
                rows = np.flatnonzero((there[0] >= r) & (there[1] >= reach - r))
                hashed = flat.mix(key[rows] + sums[0][rows, r] + sums[1][rows, reach - r] * turns[-1] + np.uint64(r))
                yield pa.RecordBatch.from_pydict(
                    {
                        "window": hashed.view(np.int64),
                        "doc_id": part["doc_id"].to_numpy()[rows],
                        "start": (part["place"].to_numpy()[rows] - (reach - r)).astype(np.int32),
                    }
                )


def _settled(suffixes: DataFrame, found: list[DataFrame], store: Store, sizes: dict[str, int]) -> DataFrame:
    """Spans of the keys of which some suffix may share more with a text than with any that it was compared with."""
    told = [
        df.where("reach IS NOT NULL").select(
            "key", "text_hash", "place", *[(F.col("reach") if side == k else F.lit(0)).alias(f"reach{k}") for k in (0, 1)], "best"
        )
        for side, df in enumerate(found)
    ]
    best = told[0].unionByName(told[1]).groupBy("key", "text_hash", "place").agg(
        F.max("reach0").alias("right"), F.max("reach1").alias("left"), F.max("best").alias("best")
    )
    reach = sizes["least"] - sizes["gram"]
    unsettled = best.where((F.col("right") + F.col("left") >= reach) & (F.col("best") < F.col("right") + F.col("left")))
    keys = store.keep(unsettled.select("key").distinct())
    asked = suffixes.withColumn("slot", _slot("key")).join(_slots(keys, "key"), "slot", "left_semi")
    windows = asked.select("key", "after", "before", "doc_id", "place").mapInArrow(partial(_windows, **sizes), WINDOW)
    windows = store.keep(windows)
    ends = F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")
    shared = windows.groupBy("window").agg(*ends).where("lo <> hi")
    other = F.when(F.col("doc_id") == F.col("lo"), F.col("hi")).otherwise(F.col("lo"))
    return windows.join(shared, "window").select(
        "doc_id", "start", (F.col("start") + sizes["least"]).alias("stop"), other.alias("other_doc_id")
    )


def repeated_passages(docs: DataFrame, least: int = LEAST_WORDS, gram: int = GRAM) -> DataFrame:
    """doc_id, start_word, end_word, n_words, n_shared, other_doc_id: passages of `least` words or more that stand in two
    documents.

    Words are runs of anything but white space, counted from 0 in each text, end exclusive. Every document of a passage has
    a row for it; passages that overlap are one. A piece of it of n_shared words stands in other_doc_id: the longest one that
    was matched around one suffix, which sees some words on each side. Documents without such passages have no row.
    Repeats inside one document don't count. Null and empty texts and texts of fewer words have no passage. Rows without
    doc_id take no part; rows of equal doc_id are one document, which shares nothing with itself. An empty table gives an
    empty result. Columns other than doc_id and text are not read.
    """
    store = Store(docs.sparkSession)
    docs = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    docs = docs.withColumn("text_hash", F.xxhash64("text"))
    sizes = {"gram": gram, "least": least}
    anchors = store.keep(docs.mapInArrow(partial(_anchors, **sizes), ANCHOR))
    ends = F.min("text_hash").alias("lo"), F.max("text_hash").alias("hi"), F.count(F.lit(1)).alias("rows")
    shared = store.keep(anchors.groupBy("key").agg(*ends).where("lo <> hi").select("key", "rows"))
    # Rows of keys that very many texts have are spread by their text as well.
    hot = _slots(shared.where(F.col("rows") > HOT_ROWS), "key").withColumn("hot", F.lit(True))
    salted = anchors.withColumn("slot", _slot("key")).join(hot, "slot", "left")
    salted = salted.withColumn("salt", F.when(F.col("hot"), F.pmod("text_hash", F.lit(SALTS))).otherwise(0).cast("int"))
    every = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    spread = shared.withColumn("slot", _slot("key")).join(hot, "slot", "left").select("key", F.explode(every).alias("salt"))
    # One document stands for all that have its text.
    # Turned keys, so that rows are combined and dealt anew: those of a common passage don't stay where they met their key.
    turned = F.col("key").bitwiseXOR(F.lit(-1))
    places = salted.join(spread, ["key", "salt"]).withColumn("key", turned).groupBy("key", "text_hash", "place")
    places = places.agg(F.min("doc_id").alias("doc_id")).withColumn("key", turned)
    places = places.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("place", "key")).alias("places"))
    suffixes = docs.join(places, ["doc_id", "text_hash"]).dropDuplicates(["doc_id", "text_hash"])
    suffixes = store.keep(suffixes.mapInArrow(partial(_suffixes, **sizes), SUFFIX))
    for done in (anchors, shared):
        store.drop(done)
    found = [_sorted_matches(suffixes, store, ["key", *order], sizes) for order in (_AFTER, _AFTER[::-1])]
    spans = [df.where("start IS NOT NULL").select("doc_id", "start", "stop", "other_doc_id") for df in found]
    spans.append(_settled(suffixes, found, store, sizes))

    copies = docs.groupBy("text_hash").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo <> hi")
    other = F.when(F.col("doc_id") == F.col("lo"), F.col("hi")).otherwise(F.col("lo"))
    whole = docs.join(copies, "text_hash").select("doc_id", other.alias("other_doc_id"), word_count().cast("int").alias("stop"))
    whole = whole.where(F.col("stop") >= least).select("doc_id", F.lit(0).alias("start"), "stop", "other_doc_id")
    islands = merged_spans(reduce(DataFrame.unionByName, spans, whole))
    n = F.col("end_word") - F.col("start_word")
    return islands.select("doc_id", "start_word", "end_word", n.alias("n_words"), "n_shared", "other_doc_id")
