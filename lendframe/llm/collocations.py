"""Phrases whose words stand together more often than their parts explain, by counting quotient filters.

1. Every shard, a run of whole texts of about `SHARD_BYTES`, becomes its distinct words with their counts, in ranges of
   their hashes, and its words in order as numbers of that list. The words of a range are counted over all shards, those that
   are frequent in their language are numbered, and each shard gets the numbers of its own words back, in its own order. So
   no task holds the vocabulary of the corpus.
2. Level by level, for n = 2 to `LONGEST`, a shard counts the n-grams both of whose (n-1)-grams are frequent; others can't
   be. Packed, permuted and sorted, its n-grams are one counting quotient filter for each range of keys (`quotient.py`).
3. The filters of a range are merged over all shards. What reaches `least` is frequent; its key gives its words back. Each
   shard gets a bit per key that it asked about, in its own order, and thus knows which places go on to the next level.
4. Frequent phrases, at most a hundredth of the words per level, are scored by joins with the counts of their parts.

A shard's memory follows SHARD_BYTES or its longest text; a range holds about `RANGE_KEYS` keys at most, as the permutation
spreads them evenly and the number of ranges follows the number of words. Frequent n-grams are one counter a shard.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lendframe.llm import flat, quotient
from lendframe.llm.files import partition
from lendframe.llm.tables import Store

LEAST, LONGEST, TOP = 100, 5, 2000
SHARD_BYTES, RANGE_KEYS = 4 << 20, 1 << 21
SALTS = 64
HASHED_WORDS = 1 << 18

SHARD = "shard long, range int, vocab array<struct<lang:string,word:string,n:long>>, stream binary"
WORDS = "shard long, range int, bits binary, lang string, word string, a long, number long"
LEVEL = "shard long, range int, data binary, flags binary"
MERGED = "shard long, range int, bits binary, ids array<long>, a long"

_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_APART = _BREAK.copy()
_APART[[0x20, 0x09]] = True


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for each run."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths) + np.repeat(starts, lengths)


def _same_bytes(data: np.ndarray, starts: np.ndarray, other: np.ndarray, lengths: np.ndarray) -> bool:
    return all(
        (data[_ranges(starts[a:b], lengths[a:b])] == data[_ranges(other[a:b], lengths[a:b])]).all() for a, b in _parts(len(starts))
    )


def _parts(n: int) -> list[tuple[int, int]]:
    """Runs of words, so that what is held per byte is held for some of them only."""
    return [(a, min(n, a + HASHED_WORDS)) for a in range(0, n, HASHED_WORDS)]


def _packed(values: np.ndarray) -> bytes:
    return zstandard.compress(values.astype("<u4").tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), "<u4")


def _numbered(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, langs: np.ndarray, salts: np.ndarray) -> tuple:
    """(first, inverse, counts, keys) of the distinct words of each language in the order of their keys, hashes of word and
    language (`salts`). Hashes tell words apart, bytes confirm it."""
    hashed = np.concatenate([flat.hashes(data, starts[a:b], stops[a:b]) for a, b in _parts(len(starts))]) ^ salts[langs]
    keys, first, inverse, counts = np.unique(hashed, return_index=True, return_inverse=True, return_counts=True)
    lengths, of = stops - starts, first[inverse]
    if (langs == langs[of]).all() and (lengths == lengths[of]).all() and _same_bytes(data, starts, starts[of], lengths):
        return first, inverse, counts, keys
    words = [(int(g), data[a:b].tobytes()) for g, a, b in zip(langs, starts, stops, strict=True)]  # two words of one hash
    seen: dict = {}
    inverse = np.array([seen.setdefault(w, len(seen)) for w in words])
    _, first, counts = np.unique(inverse, return_index=True, return_counts=True)
    order = np.argsort(hashed[first], kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return first[order], place[inverse], counts[order], hashed[first[order]]


def _shards(batches: Iterator[pa.RecordBatch], range_bits: int) -> Iterator[pa.RecordBatch]:
    number = partition() << 32
    kind = pa.struct([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])
    for rows, data, offsets in flat.slices(batches, limit=SHARD_BYTES):
        low = flat.LOWER[data]
        starts, stops, first_word = flat.split(low, offsets, ~_APART[low])
        if not len(starts):
            continue
        encoded = rows.column("lang").dictionary_encode()
        salts = flat.mix(np.array([zlib.crc32(name.encode()) + 1 for name in encoded.dictionary.to_pylist()], np.uint64))
        owner = flat.owner(first_word)
        langs = encoded.indices.to_numpy()[owner]
        first, inverse, counts, keys = _numbered(low, starts, stops, langs, salts)
        lengths = (stops - starts)[first]
        ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        letters = low[_ranges(starts[first], lengths)]
        words = pa.StringArray.from_buffers(len(first), pa.py_buffer(ends.tobytes()), pa.py_buffer(letters.tobytes()))
        vocab = pa.StructArray.from_arrays([encoded.dictionary.take(pa.array(langs[first])), words, pa.array(counts)], fields=list(kind))
        ranges = (keys >> np.uint64(64 - range_bits)).astype(np.int64)
        cuts = np.flatnonzero(np.append(True, ranges[1:] != ranges[:-1]))
        # 0 stands between pieces: where the text changes or a break lies between two words.
        breaks = np.concatenate([[0], np.cumsum(_BREAK[low], dtype=np.int32)])
        apart = (owner[1:] != owner[:-1]) | (breaks[starts[1:]] != breaks[stops[:-1]])
        stream = np.insert(inverse.astype(np.uint32) + np.uint32(1), np.flatnonzero(apart) + 1, 0)
        lists = pa.array([*cuts, len(keys), len(keys)], pa.int32())
        yield pa.RecordBatch.from_pydict(
            {
                "shard": pa.array([number] * (len(cuts) + 1), pa.int64()),
                "range": pa.array([*ranges[cuts].tolist(), None], pa.int32()),
                "vocab": pa.ListArray.from_arrays(lists, vocab),
                "stream": pa.array([*([None] * len(cuts)), _packed(stream)], pa.binary()),
            }
        )
        number += 1


def _by_range(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[int, list[int], list]]:
    """(range, shards, values of a column) of rows that are sorted by range."""
    shards, values, number = [], [], None
    for batch in batches:
        get = {name: batch.column(batch.schema.get_field_index(name)) for name in ("shard", "range", column)}
        for shard, own, value in zip(get["shard"].to_pylist(), get["range"].to_pylist(), get[column], strict=True):
            if own != number and shards:
                yield number, shards, values
                shards, values = [], []
            number = own
            shards.append(shard)
            values.append(value)
    if shards:
        yield number, shards, values


def _merge_words(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Words sorted by range: each shard's answers, the numbers in their range of its words or 0; the frequent words with
    their numbers; and how many words there are of each language, as rows without a word."""
    kinds = pa.int64(), pa.int32(), pa.binary(), pa.string(), pa.string(), pa.int64(), pa.int64()
    schema = pa.schema([(c.split()[0], kind) for c, kind in zip(WORDS.split(", "), kinds, strict=True)])

    def rows(count: int, **columns: object) -> pa.RecordBatch:
        made = {c: pa.array(columns[c], schema.field(c).type) if c in columns else pa.nulls(count, schema.field(c).type) for c in schema.names}
        return pa.RecordBatch.from_pydict(made, schema=schema)

    for number, shards, lists in _by_range(batches, "vocab"):
        found = pa.concat_arrays([x.values for x in lists])
        # Words have no line ends.
        joined = pc.binary_join_element_wise(found.field("lang"), found.field("word"), "\n").dictionary_encode()
        of, n = joined.indices.to_numpy(), found.field("n").to_numpy()
        total = np.zeros(len(joined.dictionary), np.int64)
        np.add.at(total, of, n)
        frequent = total >= least
        numbers = np.where(frequent, np.cumsum(frequent), 0)
        ends = np.cumsum([len(x.values) for x in lists])
        bits = [_packed(part) for part in np.split(numbers[of], ends[:-1])]
        yield rows(len(shards), shard=shards, range=[number] * len(shards), bits=bits)
        named = [text.split("\n", 1) for text in joined.dictionary.filter(pa.array(frequent)).to_pylist()]
        lang, word = ([x[k] for x in named] for k in (0, 1))
        yield rows(len(named), range=[number] * len(named), lang=lang, word=word, a=total[frequent], number=numbers[frequent])
        sums = pa.table({"lang": found.field("lang"), "n": found.field("n")}).group_by("lang").aggregate([("n", "sum")])
        yield rows(sums.num_rows, range=[number] * sums.num_rows, lang=sums["lang"].to_pylist(), a=sums["n_sum"].to_pylist())


class Entries:
    """The distinct n-grams of a shard that begin at the places `at`, as sorted keys, and which of them each place has."""

    def __init__(self, ids: np.ndarray, at: np.ndarray, layout: quotient.Layout):
        packed = quotient.pack([ids[at + k] for k in range(layout.n)], layout)
        parts = quotient.permute(packed, layout)
        order, heads = quotient.sorted_groups(parts, layout)
        self.at, self.counts = at, np.diff(np.append(heads, len(order)))
        self.parts = [p[order[heads]] for p in parts]
        self.of = np.empty(len(at), np.int64)
        self.of[order] = np.repeat(np.arange(len(heads)), self.counts)


def _candidates(flags: np.ndarray) -> np.ndarray:
    """Places whose own (n-1)-gram and the next one are frequent."""
    return np.flatnonzero(flags[:-1] & flags[1:])


def _level(batches: Iterator[pa.RecordBatch], n: int, bits: int, range_bits: int, word_bits: int) -> Iterator[pa.RecordBatch]:
    """Filters of the n-grams of each shard, and the shard itself as the next level needs it.

    A shard comes with the answers (range, bits) of the level before: for n = 2 the numbers of its words, of `word_bits` bits
    in each range; after that a bit for each n-gram, and with the flags of the level before that.
    """
    layout, before = quotient.Layout(n, bits), quotient.Layout(n - 1, bits)
    schema = pa.schema([("shard", pa.int64()), ("range", pa.int32()), ("data", pa.binary()), ("flags", pa.binary())])
    for batch in batches:
        column = batch.column(batch.schema.get_field_index("answers"))
        for i, row in enumerate(batch.drop_columns(["answers"]).to_pylist()):
            own = column[i].values
            if n == 2:
                ids = _unpacked(row["stream"])
                numbers = [np.zeros(1, np.uint32)]
                for answer in sorted(own.to_pylist(), key=itemgetter("range")):
                    part = _unpacked(answer["bits"])
                    numbers.append(np.where(part > 0, part | np.uint32(answer["range"] << word_bits), np.uint32(0)))
                ids = np.concatenate(numbers)[ids]
                flags = ids > 0
            else:
                ids = _unpacked(row["data"])
                flags = np.unpackbits(np.frombuffer(row["flags"], np.uint8), count=len(ids)).astype(bool)
                known = Entries(ids, _candidates(flags), before)
                answers = sorted((a["range"], a["bits"]) for a in own.to_pylist())
                sizes = np.unique(quotient.range_of(known.parts, before, min(range_bits, before.widths[0])), return_counts=True)[1]
                frequent = [np.unpackbits(np.frombuffer(b, np.uint8), count=c) for (_, b), c in zip(answers, sizes, strict=True)]
                frequent = np.concatenate(frequent).astype(bool) if frequent else np.empty(0, bool)
                flags = np.zeros(len(ids), bool)
                flags[known.at] = frequent[known.of]
                # Only words of frequent (n-1)-grams go on, the others become one break.
                used = np.zeros(len(ids) + n, bool)
                for k in range(n - 1):
                    used[k : k + len(ids)] |= flags
                used = used[: len(ids)]
                kept = used.copy()
                kept[1:] |= used[:-1]
                ids, flags = np.where(used, ids, 0)[kept], flags[kept]
            at = _candidates(flags)
            if not len(at):
                continue
            entries = Entries(ids, at, layout)
            ranges = quotient.range_of(entries.parts, layout, min(range_bits, layout.widths[0])).astype(np.int64)
            cuts = np.flatnonzero(np.append(True, ranges[1:] != ranges[:-1])[: len(ranges)])
            blobs = [
                quotient.encode([p[a:b] for p in entries.parts], entries.counts[a:b], layout, min(range_bits, layout.widths[0]))
                for a, b in zip(cuts, np.append(cuts[1:], len(ranges)), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([row["shard"]] * (len(blobs) + 1), pa.int64()),
                    pa.array([*ranges[cuts].tolist(), None], pa.int32()),
                    pa.array([*blobs, _packed(ids)], pa.binary()),
                    pa.array([*([None] * len(blobs)), np.packbits(flags).tobytes()], pa.binary()),
                ],
                schema=schema,
            )


def _merge(batches: Iterator[pa.RecordBatch], n: int, bits: int, range_bits: int, least: int) -> Iterator[pa.RecordBatch]:
    """Filters sorted by range: the frequent n-grams of each range, and each shard's answers."""
    layout = quotient.Layout(n, bits)
    range_bits = min(range_bits, layout.widths[0])
    schema = pa.schema(
        [("shard", pa.int64()), ("range", pa.int32()), ("bits", pa.binary()), ("ids", pa.list_(pa.int64())), ("a", pa.int64())]
    )

    def done(number: int, held: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        filters = [quotient.decode(data, layout, range_bits) for _, data in held]
        keys, total, group = quotient.merged([f.keys(number, layout, range_bits) for f in filters], [f.counts for f in filters], layout)
        frequent = total >= least
        ends = np.cumsum([len(f.counts) for f in filters])
        answers = [np.packbits(part).tobytes() for part in np.split(frequent[group], ends[:-1])]
        n_answers = len(answers)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([shard for shard, _ in held], pa.int64()),
                pa.array([number] * n_answers, pa.int32()),
                pa.array(answers, pa.binary()),
                pa.nulls(n_answers, schema.field("ids").type),
                pa.nulls(n_answers, pa.int64()),
            ],
            schema=schema,
        )
        found = quotient.unpack(quotient.restore([p[frequent] for p in keys], layout), layout)
        words = np.stack(found, axis=1).astype(np.int64).reshape(-1)
        some = len(words) // n
        yield pa.RecordBatch.from_arrays(
            [
                pa.nulls(some, pa.int64()),
                pa.array([number] * some, pa.int32()),
                pa.nulls(some, pa.binary()),
                pa.ListArray.from_arrays(pa.array(np.arange(some + 1) * n, pa.int32()), pa.array(words)),
                pa.array(total[frequent]),
            ],
            schema=schema,
        )

    for number, shards, blobs in _by_range(batches, "data"):
        yield from done(number, [(shard, blob.as_py()) for shard, blob in zip(shards, blobs, strict=True)])


def frequent_phrases(docs: DataFrame, least: int, longest: int, store: Store) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(words, totals, phrases): (lang, word, id, a) and (lang, n), and (ids, a) for phrases of 1 to `longest` words that
    occur `least` times or more in their language."""
    texts = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text")
    )
    parts = max(1, texts.rdd.getNumPartitions())
    buckets = max(parts, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    word_ranges = (4 * parts).bit_length()
    shards = store.keep(texts.mapInArrow(partial(_shards, range_bits=word_ranges), SHARD))
    local = shards.where("range IS NOT NULL").select("shard", "range", "vocab")
    local = local.repartition("range").sortWithinPartitions("range", "shard")
    counted = store.keep(local.mapInArrow(partial(_merge_words, least=least), WORDS))
    totals = counted.where("shard IS NULL AND word IS NULL").groupBy("lang").agg(F.sum("a").alias("n"))
    totals = store.keep(totals)
    found = counted.where("word IS NOT NULL")
    word_bits = int(found.agg(F.max("number")).first()[0] or 0).bit_length()
    bits = word_bits + word_ranges
    if bits > 32:
        raise ValueError("more than 2**32 frequent words")
    words = found.select("lang", "word", (F.col("range").cast("long") * (1 << word_bits) + F.col("number")).alias("id"), "a")
    tokens = totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    range_bits = max(0, (int(tokens) - 1) // RANGE_KEYS).bit_length()

    answers = counted.where("shard IS NOT NULL").groupBy("shard").agg(F.collect_list(F.struct("range", "bits")).alias("answers"))
    states = shards.where("range IS NULL").select("shard", "stream")
    phrases = words.select(F.array("id").alias("ids"), "a")
    for n in range(2, longest + 1):
        sizes = {"n": n, "bits": bits, "range_bits": range_bits}
        # From level 3 on shards stay in their buckets; only the answers, and then the filters, move.
        level = states.join(answers.hint("merge"), "shard")
        level = level.mapInArrow(partial(_level, **sizes, word_bits=word_bits), LEVEL)
        level = store.keep_dealt(level, "shard", buckets)
        filters = level.where("range IS NOT NULL").select("shard", "range", "data")
        ordered = filters.repartition("range").sortWithinPartitions("range", "shard")
        merged = store.keep(ordered.mapInArrow(partial(_merge, **sizes, least=least), MERGED))
        phrases = phrases.unionByName(merged.where("shard IS NULL").select("ids", "a"))
        asked = merged.where("shard IS NOT NULL")
        answers = asked.groupBy("shard").agg(F.collect_list(F.struct("range", "bits")).alias("answers"))
        states = level.where("range IS NULL").select("shard", "data", "flags")
    return words, totals, store.keep(phrases)


def scored(phrases: DataFrame, words: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, ids, a, l, r, n, score) of each phrase of two words or more, by its lowest cut.

    Products are decimals of up to 38 digits: exact for counts up to 10**17.
    """
    size = F.size("ids")
    cuts = phrases.where(size > 1).select("ids", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    left, right = F.slice("ids", 1, F.col("k")), F.slice("ids", F.col("k") + 1, size)
    cuts = cuts.select("ids", "a", "k", left.alias("left"), right.alias("right"))
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(phrases.select(F.col("ids").alias(side), F.col("a").alias(name)), side)
    of_lang = words.select("id", "lang").join(totals, "lang")
    cuts = cuts.withColumn("id", F.element_at("ids", 1)).join(of_lang, "id")
    exact = "(1000BD * CAST(a AS DECIMAL(17,0)) * CAST(n AS DECIMAL(17,0))) DIV (CAST(l AS DECIMAL(17,0)) * CAST(r AS DECIMAL(17,0)))"
    lowest = F.min(F.struct(F.expr(exact).alias("score"), "k", "l", "r")).alias("cut")
    return cuts.groupBy("lang", "ids", "a", "n").agg(lowest).select("lang", "ids", "a", "cut.l", "cut.r", "n", "cut.score")


def independent(phrases: DataFrame, scores: DataFrame) -> DataFrame:
    """Scored phrases without those that stand in a longer phrase as often as anywhere.

    It is enough to look one word further: a phrase between two of equal counts has the same count.
    """
    size = F.size("ids")
    parts = F.array(F.slice("ids", F.lit(1), size - 1), F.slice("ids", F.lit(2), size - 1))
    inside = phrases.where(size > 2).select(F.explode(parts).alias("ids"), F.col("a").alias("longer"))
    inside = inside.groupBy("ids").agg(F.max("longer").alias("longer"))
    return scores.join(inside, "ids", "left").where("longer IS NULL OR longer < a").drop("longer")


def _first(df: DataFrame, rank: Column, top: int) -> DataFrame:
    return df.withColumn("place", rank).where(F.col("place") <= top).drop("place")


def collocations(
    docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first `top` phrases of each language, of 2 to `longest` words.

    `docs` has text and lang. Words are runs of anything but space and tab in the pieces between `.,;:!?` and line ends, A-Z
    in lower case. a, l, r count a phrase and the two parts of its lowest cut, n all words of the language; only phrases of
    `least` occurrences count, and those that never stand outside a longer one are left out. Order: score, then a, highest
    first, then the phrase by its bytes. A null lang is `und`; a null or empty text has no words; every row counts, repeated
    ones too. An empty table gives an empty result. Other columns are not read.
    """
    store = Store(docs.sparkSession)
    words, totals, phrases = frequent_phrases(docs, least, longest, store)
    found = store.keep(independent(phrases, scored(phrases, words, totals)))
    # A language may hold most phrases: its first ones are taken among salted shares of it before they meet.
    order = F.desc("score"), F.desc("a")
    salt = F.pmod(F.xxhash64("ids"), F.lit(SALTS))
    found = found.withColumn("salt", salt)
    found = _first(found, F.rank().over(W.partitionBy("lang", "salt").orderBy(*order)), top).drop("salt")
    spelled = found.select("ids", F.posexplode("ids").alias("at", "id")).join(words.select("id", "word"), "id")
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"])
    spelled = spelled.groupBy("ids").agg(F.concat_ws(" ", in_order).alias("phrase"))
    found = store.keep(found.join(spelled, "ids"))
    by_name = *order, F.col("phrase")
    found = found.withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(SALTS)))
    found = _first(found, F.row_number().over(W.partitionBy("lang", "salt").orderBy(*by_name)), top)
    rank = F.row_number().over(W.partitionBy("lang").orderBy(*by_name)).cast("long")  # at most SALTS * top rows
    return found.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH pieces AS (
  SELECT lang, row_number() OVER () AS pid, regexp_extract_all(piece, '[^\x20\x09]+') AS ws
  FROM (
    SELECT coalesce(lang, 'und') AS lang,
           unnest(regexp_split_to_array(
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents)
), sizes AS (
  SELECT lang, sum(len(ws))::BIGINT AS n FROM pieces GROUP BY lang
), grams AS (
  SELECT lang, g.k, ws, unnest(range(1, len(ws) - g.k + 2)) AS s
  FROM pieces, (SELECT unnest([1, 2, 3, 4, 5]) AS k) g WHERE len(ws) >= g.k
), counts AS (
  SELECT lang, k, phrase, count(*) AS a
  FROM (SELECT lang, k, array_to_string(list_slice(ws, s, s + k - 1), ' ') AS phrase FROM grams)
  GROUP BY lang, k, phrase HAVING count(*) >= 100
), cuts AS (
  SELECT lang, k, phrase, a, string_split(phrase, ' ') AS ws, unnest(range(1, k)) AS c FROM counts WHERE k > 1
), scored AS (
  SELECT p.lang, p.k, p.phrase, p.a, p.c, x.a AS l, y.a AS r, z.n,
         ((1000::HUGEINT * p.a * z.n) // (x.a::HUGEINT * y.a))::BIGINT AS score
  FROM cuts p
  JOIN counts x ON x.lang = p.lang AND x.phrase = array_to_string(list_slice(p.ws, 1, p.c), ' ')
  JOIN counts y ON y.lang = p.lang AND y.phrase = array_to_string(list_slice(p.ws, p.c + 1, p.k), ' ')
  JOIN sizes z ON z.lang = p.lang
), lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1
), kept AS (
  SELECT * FROM lowest p WHERE NOT EXISTS (
    SELECT 1 FROM counts o
    WHERE o.lang = p.lang AND o.k > p.k AND 100 * o.a >= 100 * p.a
      AND contains(' ' || o.phrase || ' ', ' ' || p.phrase || ' '))
), ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
  FROM kept
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""
