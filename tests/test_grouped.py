"""The skew-safe building blocks against plain windows and joins, with every path forced on small data."""

import random
from datetime import date, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lendframe.functions.grouped import HotRule, global_ranks, grouped_window, hot_keys, number_rows
from lendframe.functions.pairs import pairs_within

ALL_HOT = HotRule(rows=0)
SOME_HOT = HotRule(rows=100)
NONE_HOT = HotRule()


@pytest.fixture(scope="module")
def rows(spark):
    """900 rows: key 0 holds half of them, one day of it holds a third of its rows, the rest is spread."""
    rnd = random.Random(7)
    data = []
    for i in range(900):
        key = 0 if rnd.random() < 0.5 else rnd.randint(1, 40)
        day = 5 if key == 0 and rnd.random() < 0.33 else rnd.randint(0, 30)
        data.append((key, date(2024, 1, 1) + timedelta(days=day), i, Decimal(rnd.randint(1, 20)) / 2))
    return spark.createDataFrame(data, "k long, day date, id long, amount decimal(8,2)").cache()


@pytest.mark.parametrize("rule", [ALL_HOT, SOME_HOT, NONE_HOT])
def test_grouped_window_equals_plain_window(rows, rule):
    w = W.partitionBy("k").orderBy("day", "id")
    expected = rows.select(
        "*",
        F.row_number().over(w).cast("long").alias("n"),
        F.sum("amount").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("total"),
        F.lag("day").over(w).alias("before"),
    )
    actual = grouped_window(
        rows, ["k"], ["day", "id"],
        row_number="n", running_sum={"total": "amount"}, lag={"before": "day"}, rule=rule,
    )
    assert actual.schema["total"].dataType == expected.schema["total"].dataType
    by_id = sorted(expected.collect(), key=lambda r: r.id)
    assert sorted(actual.collect(), key=lambda r: r.id) == by_id


def test_grouped_window_without_keys_numbers_all_rows(rows):
    numbered = grouped_window(rows, [], ["id"], row_number="n")
    assert [r.n for r in numbered.orderBy("id").collect()] == list(range(1, 901))
    assert number_rows(rows, "id", "n").where(F.col("n") != F.col("id") + 1).count() == 0


def test_hot_keys_finds_only_large_shares(rows):
    assert [r.k for r in hot_keys(rows, ["k"], SOME_HOT).collect()] == [0]
    assert hot_keys(rows, ["k"], NONE_HOT).count() == 0


@pytest.mark.parametrize("rule", [ALL_HOT, SOME_HOT])
def test_null_is_a_group_of_its_own(rows, rule):
    """A hot group of null keys is dealt into chunks like any other."""
    some = rows.withColumn("k", F.when(F.col("k") > 0, F.col("k")))
    numbered = grouped_window(some, ["k"], ["id"], row_number="n", rule=rule)
    expected = some.select("*", F.row_number().over(W.partitionBy("k").orderBy("id")).cast("long").alias("n"))
    assert sorted(numbered.collect(), key=lambda r: r.id) == sorted(expected.collect(), key=lambda r: r.id)


def test_chunks_follow_ranks_and_not_values(spark):
    """Ids far apart and ids close together fill chunks alike: no task of the written chunks gets all rows."""
    spread = spark.range(20_000).select((F.col("id") * F.col("id") * (1 << 21)).alias("seq"))
    settings = {"spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        numbered = number_rows(spread, "seq", "n", HotRule(rows=100))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert numbered.where(F.col("n") != F.sqrt(F.col("seq") / (1 << 21)) + 1).count() == 0
    files = {f for f in numbered.inputFiles()}
    rows = [spark.read.parquet(f).count() for f in files if "part-" in f]
    assert len(rows) > 1 and max(rows) < 0.3 * 20_000


@pytest.mark.parametrize("rule", [ALL_HOT, SOME_HOT, NONE_HOT])
def test_global_ranks_equal_plain_windows(spark, rule):
    rnd = random.Random(3)
    data = [(i, 0 if rnd.random() < 0.4 else rnd.randint(0, 60)) for i in range(500)]
    df = spark.createDataFrame(data, "id long, score long")
    down = W.orderBy(F.desc("score"))
    expected = df.select(
        "id", "score",
        F.rank().over(down).alias("a"), F.dense_rank().over(down).alias("b"),
        F.row_number().over(W.orderBy(F.desc("score"), "id")).alias("c"),
        (F.rank().over(W.orderBy("score")) - 1).alias("d"), F.lit(500).alias("e"),
    )
    actual = global_ranks(df, "score", "id", rule=rule).select(
        "id", "score", "rank_with_gaps", "rank_no_gaps", "row_num", "rows_below", "all_rows"
    )
    assert sorted(map(tuple, actual.collect())) == sorted(map(tuple, expected.collect()))


@pytest.mark.parametrize("cell_rows", [1, 3, 1000])
def test_pairs_meet_exactly_once(spark, cell_rows):
    left = spark.createDataFrame([(k, i) for k, n in [(1, 20), (2, 3)] for i in range(n)], "k long, a long")
    right = left.withColumnRenamed("a", "b")
    pairs = pairs_within(left, right, "k", "a", "b", cell_rows).where("a < b")
    expected = left.join(right, "k").where("a < b")
    assert sorted(map(tuple, pairs.select("k", "a", "b").collect())) == sorted(map(tuple, expected.collect()))


def test_empty_input(spark, rows):
    nothing = rows.where("k < 0")
    assert grouped_window(nothing, ["k"], ["id"], row_number="n").count() == 0
    assert number_rows(nothing, "id", "n").count() == 0
