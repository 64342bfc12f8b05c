"""Benchmark passages in training documents, from a positional inverted index. DataFrame functions only.

1. The index holds a posting (term, row, pos) for every place where a training document has a word of the test phrases, and
   one more per document, of term 0, whose position is the number of its words. It is written once, each part sorted by
   term, so that a list is read without the others; building it moves no text between tasks.
2. The terms of every phrase are put in the order of their list lengths. The list of the rarest is shifted by its offset in
   the phrase, which gives the places where the phrase may begin; these are intersected with the shifted list of the second
   rarest term, and what is left with all other lists. A place that stands in all shifted lists is an exact match.
3. For proximity the lists are not shifted: postings near one of the rarest term are brought together, and the shortest
   stretch of words that has all terms of the phrase is looked for among them.

All joins on postings have the row (a document) or the place in their key, so that frequent terms don't meet in one task;
lists are joined with the phrases by term alone only for the rarest term of each phrase.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lendframe.functions.grouped import number_rows
from lendframe.llm.tables import Store

WINDOW = 10
BROADCAST_ROWS = 200_000  # of at most some 50 bytes
SLOTS = 1 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
END = 0  # the term of a document's end


def words(text: str = "text") -> Column:
    """Runs of digits, letters and anything beyond ASCII, A-Z in lower case. A null text has none."""
    low = F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), UPPER, LOWER)
    return F.filter(F.split(low, BETWEEN), lambda w: w != "")


def _small(df: DataFrame, count: int) -> DataFrame:
    return F.broadcast(df) if count <= BROADCAST_ROWS else df


def _slot() -> Column:
    return F.pmod(F.xxhash64("row"), F.lit(SLOTS)).cast("int")


def _of_rows(lists: DataFrame, found: DataFrame) -> DataFrame:
    """The postings that may belong to rows of `found`: rows are told apart by at most SLOTS slots, which are broadcast, so
    that of a mostly clean corpus few postings are moved."""
    slots = F.broadcast(found.select(_slot().alias("slot")).distinct())
    return lists.withColumn("slot", _slot()).join(slots, "slot", "left_semi").drop("slot")


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct (item_id, phrase): `window` consecutive words of an item, or all of them if it has fewer."""
    items = benchmark.where("item_id IS NOT NULL").select(F.col("item_id").cast("string"), words().alias("words"))
    items = items.withColumn("n", F.size("words")).where("n > 0")
    size = F.least(F.col("n"), F.lit(window))
    at = items.select("item_id", "words", size.alias("size"), F.explode(F.sequence(F.lit(1), F.col("n") - size + 1)).alias("at"))
    return at.select("item_id", F.concat_ws(" ", F.slice("words", F.col("at"), F.col("size"))).alias("phrase")).distinct()


class Index:
    """Postings of the words of `phrases` (a column `phrase`, words between single spaces) in `docs` (doc_id, text)."""

    def __init__(self, docs: DataFrame, phrases: DataFrame, store: Store):
        self.store = store
        self.phrases = store.keep(number_rows(phrases.select("phrase").distinct(), "phrase", "w"))
        split = self.phrases.select("w", F.posexplode(F.split("phrase", " ")).alias("offset", "word"))
        terms = store.keep(number_rows(split.select("word").distinct(), "word", "term"))
        self.n_phrases, n_terms = self.phrases.count(), terms.count()
        listed = terms.unionByName(docs.sparkSession.createDataFrame([("", END)], terms.schema))
        rows = docs.select(
            F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.concat(words(), F.array(F.lit(""))).alias("words")
        )
        placed = rows.select("row", "doc_id", F.posexplode("words").alias("pos", "word")).join(_small(listed, n_terms), "word")
        doc_id = F.when(F.col("term") == END, F.col("doc_id"))
        placed = placed.select("term", "row", "pos", doc_id.alias("doc_id")).sortWithinPartitions("term", "row", "pos")
        self.postings = store.keep(placed)
        self.lists = self.postings.where(F.col("term") != END).select("term", "row", "pos")
        self.documents = self.postings.where(F.col("term") == END).select("row", "doc_id", F.col("pos").cast("long").alias("n_words"))
        lengths = self.lists.groupBy("term").agg(F.count(F.lit(1)).alias("postings"))
        # (w, size, rank, offset, term), the rarest first; phrases with a word that no document has are left out.
        of_phrase = W.partitionBy("w")
        placed = split.join(terms, "word").withColumn("size", F.count(F.lit(1)).over(of_phrase)).join(lengths, "term")
        placed = placed.withColumn("rank", F.row_number().over(of_phrase.orderBy("postings", "term", "offset")))
        placed = placed.withColumn("found", F.count(F.lit(1)).over(of_phrase)).where("found = size")
        self.places = store.keep(placed.select("w", "size", "rank", "offset", "term"))

    def _places(self, condition: str) -> DataFrame:
        return _small(self.places.where(condition), self.n_phrases)

    def exact(self) -> DataFrame:
        """(w, size, row, start): every place where a phrase stands word for word."""
        first = self.lists.join(self._places("rank = 1"), "term")
        first = first.select("w", "size", "row", (F.col("pos") - F.col("offset")).alias("start")).where("start >= 0")
        second = self._places("rank = 2").select("w", "offset", "term")
        asked = first.join(second, "w").select("w", "size", "row", "start", "term", (F.col("start") + F.col("offset")).alias("pos"))
        lists = self.lists.join(_small(second.select("term").distinct(), self.n_phrases), "term", "left_semi")
        both = asked.join(lists, ["row", "pos", "term"], "left_semi").select(*first.columns)
        found = self.store.keep(both.unionByName(first.where("size = 1")))

        rest = self._places("rank > 2").select("w", "offset", "term")
        asked = found.join(rest, "w").select("w", "size", "row", "start", "term", (F.col("start") + F.col("offset")).alias("pos"))
        lists = _of_rows(self.lists, found)
        there = asked.join(lists, ["row", "pos", "term"], "left_semi").groupBy(*found.columns).agg(F.count(F.lit(1)).alias("n"))
        return self.store.keep(there.where("n = size - 2").drop("n").unionByName(found.where("size <= 2")))

    def near(self, within: int) -> DataFrame:
        """(w, row, start, stop): of each phrase the first shortest stretch of at most `within` words of a document that
        has all words of the phrase, in any order."""
        distinct = self.places.groupBy("w", "term").agg(F.min("rank").alias("rank"))
        needed = distinct.groupBy("w").agg(F.count(F.lit(1)).alias("needed"))
        distinct = self.store.keep(distinct.join(needed, "w"))
        bucket = F.floor(F.col("pos") / F.lit(within))
        anchors = self.lists.join(_small(distinct.where("rank = 1").select("w", "term"), self.n_phrases), "term")
        anchors = anchors.select("w", "row", F.col("pos").alias("anchor"), bucket.alias("own"))
        reach = anchors.withColumn("bucket", F.explode(F.sequence(F.col("own") - 1, F.col("own") + 1))).drop("own")
        lists = self.lists.withColumn("bucket", bucket)
        asked = reach.join(distinct.select("w", "term", "needed"), "w")
        around = asked.join(lists, ["row", "bucket", "term"]).where(F.abs(F.col("pos") - F.col("anchor")) < within)
        # At most 2 * within rows of one anchor; a stretch holds its anchor.
        frame = W.partitionBy("w", "row", "anchor").orderBy(F.col("pos").cast("long")).rangeBetween(0, within - 1)
        ahead = around.withColumn("ahead", F.collect_list(F.struct("term", "pos")).over(frame)).where("pos <= anchor")
        first = F.aggregate(
            "ahead",
            F.create_map().cast("map<long,int>"),
            lambda seen, x: F.when(F.map_contains_key(seen, x["term"]), seen).otherwise(
                F.map_concat(seen, F.create_map(x["term"], x["pos"]))
            ),
        )
        ahead = ahead.withColumn("first", F.map_values(first)).where("size(first) = needed")
        ahead = ahead.select("w", "row", F.col("pos").alias("start"), (F.array_max("first") + 1).alias("stop"))
        best = ahead.groupBy("w", "row").agg(F.min(F.struct((F.col("stop") - F.col("start")).alias("n"), "start", "stop")).alias("b"))
        return best.select("w", "row", "b.start", "b.stop")


def passages(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, item_id, start_word, end_word: where a document has a window of a benchmark item, end exclusive.

    See `decontamination` for words, nulls and repeats; a window that several items have is told once for each.
    """
    store = Store(docs.sparkSession)
    windows = store.keep(item_windows(benchmark, window))
    index = Index(docs, windows, store)
    found = index.exact().join(index.phrases, "w").join(windows, "phrase").join(index.documents, "row")
    return found.select("doc_id", "item_id", F.col("start").alias("start_word"), (F.col("start") + F.col("size")).alias("end_word"))


def nearby(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, within: int = 2 * WINDOW) -> DataFrame:
    """doc_id, item_id, phrase, start_word, end_word: the shortest stretch of at most `within` words of a document that has
    all words of a window, in any order and with others in between; the first one of equally short ones."""
    store = Store(docs.sparkSession)
    windows = store.keep(item_windows(benchmark, window))
    index = Index(docs, windows, store)
    found = index.near(within).join(index.phrases, "w").join(windows, "phrase").join(index.documents, "row")
    return found.select("doc_id", "item_id", "phrase", F.col("start").alias("start_word"), F.col("stop").alias("end_word"))


def decontamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A window is `window` consecutive words of an item (item_id, text), or the whole of a shorter item; n_hit counts the words
    of the document that lie inside any occurrence of a window, n_items the items with a window that occurs, items_sha256 is
    that of their ids, sorted as strings and comma-joined. A null or empty text has no words. Rows without item_id take no
    part; rows of one item_id are one item. Rows of `docs` are independent of each other, repeated and null doc_ids
    included. Without items nothing is hit; without documents the result is empty. Other columns are not read.
    """
    store = Store(docs.sparkSession)
    windows = store.keep(item_windows(benchmark, window))
    index = Index(docs, windows, store)
    found = index.exact()
    inside = F.explode(F.sequence(F.col("start"), F.col("start") + F.col("size").cast("int") - 1)).alias("pos")
    hits = found.select("row", inside).distinct().groupBy("row").agg(F.count(F.lit(1)).alias("n_hit"))
    # Documents with the same windows have the same items: copies are looked up once.
    held = found.groupBy("row").agg(F.array_sort(F.collect_set("w")).alias("windows"))
    held = store.keep(held)
    named = held.select("windows").distinct().select("windows", F.explode("windows").alias("w"))
    named = named.join(index.phrases, "w").join(windows, "phrase").select("windows", "item_id").distinct()
    ids = F.array_sort(F.collect_list("item_id"))
    named = named.groupBy("windows").agg(
        F.count(F.lit(1)).alias("n_items"), F.sha2(F.concat_ws(",", ids), 256).alias("items_sha256")
    )
    of_row = held.join(named, "windows").select("row", "n_items", "items_sha256").join(hits, "row")
    whole = index.documents.join(of_row, "row", "left")
    return whole.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents
), items AS (
  SELECT item_id::VARCHAR AS item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark WHERE item_id IS NOT NULL
), item_starts AS (
  SELECT item_id, ws, least(len(ws), 10) AS size, unnest(range(0, len(ws) - least(len(ws), 10) + 1)) AS s
  FROM items WHERE len(ws) > 0
), windows AS (
  SELECT DISTINCT item_id, size, array_to_string(list_slice(ws, s + 1, s + size), ' ') AS phrase FROM item_starts
), doc_starts AS (
  SELECT d.rid, d.ws, z.size, unnest(range(0, len(d.ws) - z.size + 1)) AS s
  FROM docs d, (SELECT DISTINCT size FROM windows) z WHERE len(d.ws) >= z.size
), found AS (
  SELECT rid, s, size, phrase
  FROM (SELECT rid, s, size, array_to_string(list_slice(ws, s + 1, s + size), ' ') AS phrase FROM doc_starts)
  WHERE phrase IN (SELECT phrase FROM windows)
), hits AS (
  SELECT rid, count(*) AS n_hit
  FROM (SELECT DISTINCT rid, pos FROM (SELECT rid, unnest(range(s, s + size)) AS pos FROM found)) GROUP BY rid
), named AS (
  SELECT rid, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS items_sha256
  FROM (SELECT DISTINCT f.rid, w.item_id FROM found f JOIN windows w USING (phrase)) GROUP BY rid
)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit,
       coalesce(n.n_items, 0)::BIGINT AS n_items, coalesce(n.items_sha256, sha256('')) AS items_sha256,
       h.n_hit IS NOT NULL AS contaminated
FROM docs d LEFT JOIN hits h USING (rid) LEFT JOIN named n USING (rid)
"""
