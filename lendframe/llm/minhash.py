"""Near-duplicate documents from keys made of several min-wise hashes.

1. Each text becomes the set of its distinct word shingles, as 64-bit hashes. Texts with equal sets are one class.
2. Keys. Under a random order of all shingles, two sets have the same first element with a probability of their Jaccard
   similarity s. A key is a hash of the first elements under k orders, so two sets agree in it with s**k: sets that have
   little in common hardly ever do, however many there are. There are as many keys as let but one pair in 10**9 of those
   that reach the bound agree in one at least. A bit of each first element is kept, too: the number of bits that differ
   estimates the similarity.
3. Lists of classes by key; most keys are of one class only and generate nothing. Lists of up to `SHORT` classes give all
   their pairs, longer ones pair every class with one pivot. Pairs whose bits don't rule out that they reach the bound are
   compared on full sets.
4. Long lists whose classes don't all hang together by then are compared block by block, first the bits, then the full sets
   of those that may reach the bound. Only pairs of different components are looked at, and a block reports a spanning
   forest of its links, so what comes out is linear.

Full sets are written once, to files in the shared folder, and read from there by the tasks that compare them: what moves is
a few numbers for each key, pair and member of a list, never a set. Everything but a block of about `BLOCK_SHINGLES` and a
pair of sets is spread over tasks; no list is collected as a whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lendframe.llm import files, flat
from lendframe.llm.components import components
from lendframe.llm.tables import Store

KEY, SHINGLE, PERCENT = 6, 5, 80
SHORT, BLOCK_SHINGLES, BLOCK_BITS, TASK_ROWS = 8, 1 << 21, 1 << 13, 1 << 13
MISSED = 5e-10  # by the keys, and by the bits
BROADCAST_IDS = 500_000
DIGEST = ["digest_a", "digest_b", "n"]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer words has one shingle, its whole sequence."""
    low = flat.LOWER[data]
    starts, stops, first = flat.words(low, offsets)
    hashed = flat.hashes(low, starts, stops)
    keys, where = flat.windows(hashed, first, size)
    cuts = np.searchsorted(where, first)
    counts = np.diff(first)
    sets = [np.unique(keys[a:b].view(np.int64)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    for i in np.flatnonzero((counts > 0) & (counts < size)):
        n = int(counts[i])
        sets[i] = flat.windows(hashed[first[i] : first[i + 1]], np.array([0, n]), n)[0].view(np.int64)
    return sets


def key_count(k: int, percent: int) -> int:
    """How many keys of k hashes each let no more than MISSED of the pairs of that similarity go without a common one."""
    return max(1, math.ceil(math.log(MISSED) / math.log1p(-min((percent / 100) ** k, 1 - 1e-9))))


@cache
def most_differing(bits: int, percent: int) -> int:
    """How many of the bits differ at most, but for MISSED of the pairs of that similarity.

    First elements that are not the same have the same bit half the time.
    """
    differs = (1 - percent / 100) / 2
    found, most = 0.0, bits
    while most and found + (here := math.comb(bits, most) * differs**most * (1 - differs) ** (bits - most)) <= MISSED:
        found, most = found + here, most - 1
    return most


@cache
def _orders(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Factors (odd) and terms that put 32-bit hashes in so many orders, the same in every process."""
    drawn = flat.mix(flat.mix(np.arange(1, 2 * count + 1, dtype=np.uint64)) + np.uint64(count))
    drawn = (drawn >> np.uint64(32)).astype(np.uint32)
    return drawn[:count] | np.uint32(1), drawn[count:]


def words_of(k: int, percent: int) -> list[str]:
    """Names of the columns that hold 64 bits of a class each."""
    return [f"bits_{i}" for i in range(-(-key_count(k, percent) * k // 64))]


def signatures(sets: list[np.ndarray], k: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Per set (none is empty) its keys, and its bits as words of 64."""
    keys = key_count(k, percent)
    sizes = np.array([len(s) for s in sets])
    short = (np.concatenate(sets).view(np.uint64) >> np.uint64(32)).astype(np.uint32)
    starts = np.cumsum(sizes) - sizes
    least, moved = np.empty((keys * k, len(sets)), np.uint32), np.empty_like(short)
    for row, factor, term in zip(least, *_orders(keys * k), strict=True):
        np.multiply(short, factor, out=moved)
        moved += term
        np.minimum.reduceat(moved, starts, out=row)
    # The number of the order goes in, so that keys of different orders are different.
    mixed = flat.mix(least + (np.arange(1, keys * k + 1, dtype=np.uint64) << np.uint64(32))[:, None])
    joint = np.zeros((keys, len(sets)), np.uint64)
    for hashed in mixed.reshape(keys, k, -1).transpose(1, 0, 2):
        joint = flat.mix(joint + hashed)
    bits = np.zeros((len(words_of(k, percent)) * 64, len(sets)), np.uint8)
    bits[: keys * k] = mixed >> np.uint64(63)
    packed = np.packbits(bits, axis=0).T
    return joint.T.view(np.int64), np.ascontiguousarray(packed).view(np.int64)


def _digests(sets: list[np.ndarray]) -> dict:
    spread = [flat.mix(s.view(np.uint64) + np.uint64(1)).sum(dtype=np.uint64) for s in sets]
    return {
        "n": np.array([len(s) for s in sets], np.int64),
        "digest_a": np.array([s.sum(dtype=np.int64) for s in sets], np.int64),
        "digest_b": np.array(spread, np.uint64).view(np.int64),
    }


def _sketches(batches: Iterator[pa.RecordBatch], size: int, k: int, percent: int) -> Iterator[pa.RecordBatch]:
    words = words_of(k, percent)
    for rows, data, offsets in flat.slices(batches):
        sets = shingle_sets(data, offsets, size)
        found = _digests(sets)
        # A set of fewer elements is similar enough to itself only.
        listed = np.flatnonzero((found["n"] > 0) & (100 * found["n"] >= percent * (found["n"] + 1)))
        keys, bits = np.empty((0, 0), np.int64), np.zeros((len(sets), len(words)), np.int64)
        if len(listed):
            keys, bits[listed] = signatures([sets[i] for i in listed], k, percent)
        counts = np.zeros(len(sets), np.int64)
        counts[listed] = keys.shape[1]
        ends = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
        found |= {"keys": pa.ListArray.from_arrays(ends, pa.array(keys.ravel()))}
        found |= {word: np.ascontiguousarray(bits[:, i]) for i, word in enumerate(words)}
        yield pa.RecordBatch.from_pydict({"doc_id": rows.column("doc_id")} | found)


def _sets(batches: Iterator[pa.RecordBatch], size: int, folder: str) -> Iterator[pa.RecordBatch]:
    """Write the sets to a file of the task's own, and say where each begins."""
    uri, stream, start = None, None, 0
    for rows, data, offsets in flat.slices(batches):
        if stream is None:
            uri, stream = files.new_file(folder, ".sets")
        sets = shingle_sets(data, offsets, size)
        found = _digests(sets)
        for values in sets:
            stream.write(values.tobytes())
        starts = start + np.cumsum(found["n"]) - found["n"]
        start += int(found["n"].sum())
        yield pa.RecordBatch.from_pydict(
            {"doc_id": rows.column("doc_id")} | found | {"uri": pa.array([uri] * len(sets), pa.string()), "start": starts}
        )
    if stream is not None:
        stream.close()


def read_sets(uris: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """The sets at these places, each read once. A set that isn't empty is told by where it begins."""
    at, where = np.unique(starts, return_inverse=True)
    names, of = np.unique(uris, return_inverse=True)
    places, inverse = np.unique(of * len(at) + where, return_inverse=True)
    first = np.full(len(places), -1)
    first[inverse[::-1]] = np.arange(len(inverse))[::-1]
    found, open_name, stream = [], None, None
    for i in first:
        if open_name != names[of[i]]:
            if stream is not None:
                stream.close()
            open_name = names[of[i]]
            stream = files.open_file(open_name)
        found.append(np.frombuffer(stream.read_at(int(sizes[i]) * 8, int(starts[i]) * 8), np.int64))
    if stream is not None:
        stream.close()
    return [found[i] for i in inverse]


def key_lists(classes: DataFrame) -> DataFrame:
    """(key, doc_id, m): every class under its keys; m classes have the key, those of one class only are left out.

    A key and an id are all that moves, once.
    """
    listed = classes.select("doc_id", F.explode("keys").alias("key"))
    return listed.withColumn("m", F.count(F.lit(1)).over(W.partitionBy("key"))).where("m > 1").select("key", "doc_id", "m")


def first_pairs(lists: DataFrame) -> DataFrame:
    """Distinct (a, b): all pairs of short lists, and every class of a long list with the list's pivot."""
    short = lists.where(f"m <= {SHORT}").groupBy("key").agg(F.collect_set("doc_id").alias("ids"))
    within = short.select("ids", F.explode("ids").alias("a")).select("a", F.explode("ids").alias("b"))
    longer = lists.where(f"m > {SHORT}").select("key", "doc_id")
    pivots = longer.groupBy("key").agg(F.min_by("doc_id", F.xxhash64("doc_id")).alias("pivot"))
    to_pivot = longer.join(pivots, "key").select(F.least("doc_id", "pivot").alias("a"), F.greatest("doc_id", "pivot").alias("b"))
    return within.unionByName(to_pivot).where("a < b").distinct()


def estimated(pairs: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs whose sizes and bits do not rule out that they are similar enough."""
    words = words_of(k, percent)
    for side in "ab":
        known = [F.col(name).alias(f"{side}_{name}") for name in ("n", *words)]
        pairs = pairs.join(classes.select(F.col("doc_id").alias(side), *known), side)
    differ = sum((F.bit_count(F.col(f"a_{w}").bitwiseXOR(F.col(f"b_{w}"))) for w in words), F.lit(0))
    fit = 100 * F.least("a_n", "b_n") >= percent * F.greatest("a_n", "b_n")
    return pairs.where(fit & (differ <= most_differing(key_count(k, percent) * k, percent))).select("a", "b").distinct()


def _compared(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.to_pandas()
        # About BLOCK_SHINGLES elements are held at once.
        load = np.cumsum(rows["a_n"].to_numpy() + rows["b_n"].to_numpy()) // BLOCK_SHINGLES
        links = [np.zeros(0, bool)]
        for cut in np.split(np.arange(len(rows)), np.flatnonzero(np.diff(load)) + 1):
            some, similar = rows.iloc[cut], []
            both = [np.concatenate([some[f"{side}_{name}"].to_numpy() for side in "ab"]) for name in ("uri", "start", "n")]
            sets = read_sets(*both)
            for one, other in zip(sets[: len(some)], sets[len(some) :], strict=True):
                values = np.concatenate([one, other])
                values.sort()
                shared = np.count_nonzero(values[1:] == values[:-1])
                similar.append(100 * shared >= percent * (len(values) - shared))
            links.append(np.array(similar, bool))
        yield pa.RecordBatch.from_pandas(rows.loc[np.concatenate(links), ["a", "b"]], preserve_index=False)


def verified(pairs: DataFrame, places: DataFrame, percent: int) -> DataFrame:
    """The pairs that are similar enough on their full sets."""
    for side in "ab":
        known = [F.col(name).alias(f"{side}_{name}") for name in ("uri", "start", "n")]
        pairs = pairs.join(places.select(F.col("doc_id").alias(side), *known), side)
    return pairs.mapInArrow(partial(_compared, percent=percent), "a long, b long").distinct()


def forest(sets: list[np.ndarray], comps: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> list[tuple]:
    """Links between sets of different components, as a spanning forest: one of `left` and one of `right` each.

    Each left set's overlaps with all right ones come from the inverted lists of the right sets' shingles.
    """
    sizes = np.array([len(s) for s in sets])
    values = np.concatenate([sets[j] for j in right])
    of = np.repeat(np.arange(len(right)), sizes[right])
    order = np.argsort(values, kind="stable")
    values, of = values[order], of[order]
    comps = comps.copy()
    links = []
    for i in left:
        low, high = np.searchsorted(values, sets[i]), np.searchsorted(values, sets[i], "right")
        lengths = high - low
        ends = np.cumsum(lengths)
        if not ends[-1]:
            continue
        at = np.arange(ends[-1]) - np.repeat(ends - lengths, lengths) + np.repeat(low, lengths)
        both = np.bincount(of[at], minlength=len(right))
        similar = 100 * both >= percent * (sizes[i] + sizes[right] - both)
        for j in right[np.flatnonzero(similar)]:
            if comps[i] != comps[j]:
                links.append((i, j))
                comps[comps == comps[j]] = comps[i]
    return links


def _near(bits: np.ndarray, comps: np.ndarray, left: np.ndarray, right: np.ndarray, most: int) -> np.ndarray:
    """Which rows have one of another component on the other side of which no more than `most` bits differ."""
    near = np.zeros(len(comps), bool)
    for i in left:
        fit = right[np.bitwise_count(bits[right] ^ bits[i]).sum(axis=1, dtype=np.int64) <= most]
        fit = fit[comps[fit] != comps[i]]
        near[fit] = True
        near[i] |= len(fit) > 0
    return near


def _blocks(rows: pd.DataFrame, words: list[str], most: int, percent: int) -> pd.DataFrame:
    """One block, or two of a list: rows of block `x` against rows of block `y`."""
    ids, own = rows["doc_id"].to_numpy(), rows["block"].to_numpy()
    x, y = rows["x"].iloc[0], rows["y"].iloc[0]
    comps = np.unique(rows["component"].to_numpy(), return_inverse=True)[1]
    bits = rows[words].to_numpy(np.int64).view(np.uint64)
    # Classes of the largest component needn't be compared with each other: the others look for links.
    main = np.bincount(comps).argmax()
    links = []
    for a, b in {(x, y), (y, x)}:
        left, right = np.flatnonzero((own == a) & (comps != main)), np.flatnonzero(own == b)
        if len(left) and len(right) and len(rows) <= BLOCK_BITS:  # many sets in a block are small ones, quickly compared
            near = _near(bits, comps, left, right, most)
            left, right = left[near[left]], right[near[right]]
        if len(left) and len(right):
            used = np.union1d(left, right)
            some = rows.iloc[used]
            sets = read_sets(some["uri"].to_numpy(), some["start"].to_numpy(), some["n"].to_numpy())
            found = forest(sets, comps[used], np.searchsorted(used, left), np.searchsorted(used, right), percent)
            links += [(used[i], used[j]) for i, j in found]
    return pd.DataFrame([(ids[i], ids[j]) for i, j in links], columns=["a", "b"], dtype="int64")


def block_links(
    lists: DataFrame, labels: DataFrame, classes: DataFrame, places: DataFrame, k: int, percent: int, store: Store
) -> DataFrame:
    """Links between components inside long lists that hold several: each list is cut into blocks of about BLOCK_SHINGLES,
    and every block meets itself and every later one. Tasks are made by rows: these are small for what is done with them.
    """
    named = (
        lists.where(f"m > {SHORT}")
        .join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        .withColumn("component", F.coalesce("component", "doc_id"))
        .join(places, "doc_id")
    )
    open_lists = named.groupBy("key").agg(
        F.sum("n").alias("shingles"), F.min("component").alias("lo"), F.max("component").alias("hi")
    ).where("lo <> hi")
    blocks = open_lists.select("key", F.ceil(F.col("shingles") / BLOCK_SHINGLES).alias("blocks"))
    cut = named.join(blocks, "key").withColumn("block", F.pmod(F.xxhash64("doc_id"), "blocks"))
    words = words_of(k, percent)
    cut = cut.join(classes.select("doc_id", *DIGEST, *words), ["doc_id", *DIGEST])
    pairs = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1),
        lambda o: F.struct(F.least("block", o).alias("x"), F.greatest("block", o).alias("y")),
    )
    cut = cut.select("*", F.explode(pairs).alias("p"))
    cut = store.keep(cut.select("key", "doc_id", "component", "block", "p.x", "p.y", "uri", "start", "n", *words))
    parts = max(1, -(-cut.count() // TASK_ROWS))
    most = most_differing(key_count(k, percent) * k, percent)

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        return _blocks(rows, words, most, percent)

    dealt = cut.repartition(parts, "key", "x", "y")
    return dealt.groupBy("key", "x", "y").applyInPandas(compare, "a long, b long")


def near_duplicates(
    docs: DataFrame, size: int = SHINGLE, k: int = KEY, percent: int = PERCENT
) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Documents are linked if 100 * |intersection| >= percent * |union| of their sets of `size`-word shingles; component_id
    is the smallest doc_id in reach. A null or empty text has an empty set and is linked with nothing. A null doc_id can't
    be linked: its component_id is null and it is kept. Rows that repeat a doc_id are the same document. Equal rows stay
    equal rows; an empty table gives an empty result. Columns other than doc_id and text are not read. k hashes make a key.
    """
    store = Store(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    words = words_of(k, percent)
    kind = "doc_id long, n long, digest_a long, digest_b long"
    sketch_type = ", ".join([kind, "keys array<long>", *(f"{word} long" for word in words)])
    sketches = store.keep(docs.mapInArrow(partial(_sketches, size=size, k=k, percent=percent), sketch_type))
    rows = store.keep(sketches.select("doc_id", *DIGEST))
    classes = sketches.where("n > 0 AND doc_id IS NOT NULL").groupBy(*DIGEST)
    # Equal sets have equal keys and bits.
    same = [F.first(name).alias(name) for name in ("keys", *words)]
    classes = store.keep(classes.agg(F.min("doc_id").alias("doc_id"), *same))
    store.drop(sketches)
    lists = store.keep(key_lists(classes))
    pairs = store.keep(estimated(first_pairs(lists), classes, k, percent))

    wanted = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id")))
    wanted = store.keep(wanted.unionByName(lists.where(f"m > {SHORT}").select("doc_id")).distinct())
    small = wanted.count() <= BROADCAST_IDS
    texts = docs.join(F.broadcast(wanted) if small else wanted, "doc_id", "left_semi")
    places = texts.mapInArrow(partial(_sets, size=size, folder=f"{store.folder}/sets"), f"{kind}, uri string, start long")
    # Rows that repeat a doc_id and its text have the same set.
    places = store.keep(store.keep(places).where("n > 0").dropDuplicates(["doc_id", *DIGEST]))

    edges = store.keep(verified(pairs, places, percent))
    more = store.keep(block_links(lists, components(edges, store), classes, places, k, percent, store))
    # Copies go by the head of their class, so that no edges are needed for them; ids of several texts link their classes.
    headed = rows.join(classes.select(*DIGEST, F.col("doc_id").alias("head")), DIGEST, "left")
    headed = store.keep(headed.withColumn("head", F.when(F.col("doc_id").isNotNull(), F.col("head"))))
    several = headed.groupBy("doc_id").agg(F.min("head").alias("b"), F.max("head").alias("last")).where("b <> last")
    repeated = headed.join(several, "doc_id").select(F.col("head").alias("a"), "b").where("a <> b").distinct()
    labels = components(edges.unionByName(more).unionByName(repeated), store)

    found = headed.join(labels, F.col("head") == F.col("node"), "left")
    found = found.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "head", "doc_id").alias("component_id"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return found.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))
