"""Mixing sources to target weights by weighted fair queueing, with DataFrame functions only.

Every source is shuffled by a hash of its doc_ids and read round after round. A copy of a document gets the virtual finish
time (words of its source up to its own end, over all rounds) / (target of its source). Copies in the order of their finish
times, over all sources, are taken until the budget is used up: at time 1 every source has given its target.

Running sums are never one window over a source or over all rows: rows are dealt into chunks by a hash (within a source)
or by finish time (over all), chunks are summed up first and their sums carried over, and a window runs inside one chunk.
The number of chunks follows the number of rows, so a chunk stays small however large its source is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lendframe.llm.tables import Store

WEIGHTS = 1, 2, 3
ROUNDS = 3
CHUNK_ROWS = 50_000


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, rounds: int = ROUNDS) -> DataFrame:
    """(source, source_size, target): the whole size shared by weight, no target above `rounds` times its source's size.

    Weights repeat over the sources in order of their names by code point, null last. Resharing an excess ends with every
    source either at its bound or at a common level times its weight; sources reach their bounds in the order of
    bound / weight, so the level is found by running sums in that order. There is one row per source here.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*(F.lit(w).cast("long") for w in weights)), (place + 1).cast("int"))
    named = sources.withColumn("weight", weight).withColumn("bound", rounds * F.col("source_size"))
    by_bound = W.orderBy(F.col("bound") / F.col("weight"), F.col("source").asc_nulls_last())
    so_far, whole = by_bound.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    named = named.select(
        "*",
        (F.sum("source_size").over(whole) - F.coalesce(F.sum("bound").over(so_far), F.lit(0))).alias("left"),
        (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(so_far), F.lit(0))).alias("sharers"),
    )
    level = F.col("left").cast("double") / F.col("sharers")
    # The first source whose bound is not below its share sets the level for itself and all after it.
    free = F.col("bound") >= level * F.col("weight")
    first = F.min(F.when(free, F.struct((F.col("bound") / F.col("weight")).alias("at"), level.alias("level")))).over(whole)
    named = named.withColumn("level", first["level"])
    target = F.least(F.col("bound").cast("double"), F.col("level") * F.col("weight"))
    return named.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def finish_times(sizes: DataFrame, targets: DataFrame, chunks: int) -> DataFrame:
    """Adds source_size, target and `upto`: the words of the shuffled source up to the end of this document."""
    # A shuffle that any engine can repeat; the chunk is the head of the same hash.
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    keyed = sizes.withColumn("key", key).withColumn(
        "chunk", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * F.lit(chunks) / F.lit(1 << 32))
    )
    sums = keyed.groupBy("source", "chunk").agg(F.sum("size").alias("chunk_size"))
    before = W.partitionBy("source").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("source", "chunk", F.coalesce(F.sum("chunk_size").over(before), F.lit(0)).alias("before"))
    sums = sums.join(targets, F.expr("source <=> target_source"))
    within = W.partitionBy("source", "chunk").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    inside = keyed.withColumn("inside", F.sum("size").over(within))
    joined = inside.alias("i").join(sums.alias("s"), F.expr("i.source <=> s.source AND i.chunk = s.chunk"))
    return joined.select(
        "doc_id", "i.source", "size", "source_size", "target", (F.col("before") + F.col("inside")).alias("upto"), "key"
    )


def _mixed(docs: DataFrame, weights: tuple[int, ...], rounds: int, chunk_rows: int) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of each row."""
    store = Store(docs.sparkSession)
    sizes = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), word_count().alias("size"))
    sizes = store.keep(sizes)
    total = sizes.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("size"), F.lit(0)).alias("words")).first()
    chunks = max(1, -(-total["rows"] // chunk_rows))
    targets = source_targets(sizes, weights, rounds).withColumnRenamed("source", "target_source")
    timed = store.keep(finish_times(sizes, targets, chunks))

    copies = F.transform(F.sequence(F.lit(0), F.lit(rounds - 1)), lambda r: r * F.col("source_size") + F.col("upto"))
    finish = F.transform(copies, lambda end: end / F.col("target"))
    timed = timed.withColumn("finish", F.when((F.col("size") > 0) & (F.col("target") > 0), finish))

    # The budget ends soon after finish time 1; beyond 2 slots needn't be told apart.
    def slot(f: Column) -> Column:
        return F.least(F.floor(f * chunks), F.lit(2 * chunks).cast("long"))

    every = timed.select("size", F.explode("finish").alias("finish")).withColumn("slot", slot(F.col("finish")))
    slots = every.groupBy("slot").agg(F.sum("size").alias("words"))
    upto = W.orderBy("slot").rowsBetween(W.unboundedPreceding, 0)  # one row per slot
    over = slots.withColumn("upto", F.sum("words").over(upto)).where(F.col("upto") > total["words"])
    line = over.orderBy("slot").first()
    taken = F.col("finish")
    if line:
        # Copies of the slot in which the budget ends count one by one, equal finish times together.
        running = F.sum("size").over(W.orderBy("finish")) + (line["upto"] - line["words"])
        edge = every.where(F.col("slot") == line["slot"]).select("finish", running.alias("running"))
        cutoff = edge.where(F.col("running") <= total["words"]).agg(F.max("finish")).first()[0]
        taken = F.filter("finish", lambda f: (slot(f) < line["slot"]) | (f <= (-1.0 if cutoff is None else cutoff)))
    words = F.col("size") * F.coalesce(F.size(F.when(F.col("finish").isNotNull(), taken)), F.lit(0))
    return timed.select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        F.when(F.col("finish").isNull(), 0).otherwise(words).cast("long").alias("taken"),
    )


def mix(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, rounds: int = ROUNDS, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """One row per row of `docs` (doc_id, text, source): size, source_size, target and `taken` words.

    `taken` counts all copies of the document that the mix takes, whole copies only, at most `rounds`. A null text has size
    0 and is taken 0 times; null sources are one source, the last; rows of one doc_id stand next to each other in the
    shuffle, rows that are equal in doc_id, source and size may swap their results. An empty table gives an empty result.
    Other columns are not read.
    """
    return _mixed(docs, weights, rounds, chunk_rows).drop("source")


def mix_documents(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, rounds: int = ROUNDS, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """A row of `docs`, with all its columns, for each copy that `mix` takes."""

    def keyed(df: DataFrame, source: Column, doc_id: Column, size: Column, order: Column, *more: Column) -> DataFrame:
        """Rows numbered within doc_id, source and size, with keys that are never null."""
        keys = [
            F.coalesce(doc_id, F.lit(0)).alias("k_id"),
            doc_id.isNull().alias("k_none"),
            F.coalesce(source, F.lit("")).alias("k_source"),
            source.isNull().alias("k_nowhere"),
            size.alias("k_size"),
        ]
        names = ["k_id", "k_none", "k_source", "k_nowhere", "k_size"]
        df = df.select(*keys, order.alias("k_order"), *more)
        number = F.row_number().over(W.partitionBy(*names).orderBy("k_order"))  # rows that differ in nothing that counts
        return df.withColumn("k_number", number).drop("k_order")

    mixed = _mixed(docs, weights, rounds, chunk_rows).where("taken > 0")
    mixed = keyed(
        mixed, F.col("source"), F.col("doc_id"), F.col("size"), -F.col("taken"), (F.col("taken") / F.col("size")).cast("int").alias("copies")
    )
    source, doc_id = F.col("source").cast("string"), F.col("doc_id").cast("long")
    rows = keyed(docs, source, doc_id, word_count(), F.col("text"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    taken = rows.join(mixed, ["k_id", "k_none", "k_source", "k_nowhere", "k_size", "k_number"])
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


# The same in one statement; the words of a source, and of all copies, are summed up in plain windows here.
SQL = """
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM sizes GROUP BY source
), shares AS (
  SELECT source, source_size, weight, 3 * source_size AS bound,
         (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER before, 0))::DOUBLE
           / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::BIGINT AS level
  FROM sources
  WINDOW before AS (ORDER BY 3 * source_size / weight, source NULLS LAST
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT arg_min(level, bound / weight) AS level FROM shares WHERE bound >= level * weight
), targets AS (
  SELECT source, source_size, least(bound::DOUBLE, level.level * weight) AS target FROM shares, level
), ends AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY md5(coalesce(s.doc_id::VARCHAR, '')), s.doc_id, s.size
                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS upto
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), copies AS (
  SELECT e.doc_id, e.size, (r.round * e.source_size + e.upto)::DOUBLE / e.target AS finish
  FROM ends e, (SELECT unnest([0, 1, 2]) AS round) r WHERE e.size > 0 AND e.target > 0
), counted AS (
  SELECT doc_id, size, sum(size) OVER (ORDER BY finish) AS running FROM copies
), taken AS (
  SELECT doc_id, sum(size)::BIGINT AS taken FROM counted
  WHERE running <= (SELECT sum(size) FROM sizes) GROUP BY doc_id
)
SELECT e.doc_id, e.size, e.source_size, e.target, coalesce(t.taken, 0)::BIGINT AS taken
FROM ends e LEFT JOIN taken t USING (doc_id)
"""
