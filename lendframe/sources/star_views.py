"""Library-shaped tables derived from the star-schema parquet files (customer, part, orders, lineitem).

The views are lazy: a query that needs two columns of loans reads only what those columns depend on. FIXTURES.md states
the same rules in words, `plans/oracle.py` states them in SQL.
"""

from __future__ import annotations

from datetime import date
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lendframe.functions import columns as c
from lendframe.functions.grouped import DEFAULT_RULE, HotRule, grouped_window, hot_keys
from lendframe.schema import TableSet, conform
from lendframe.sources.workspace import work_dir, written

# Fixed values of the derived library: its reporting day and the horizon for open loans.
AS_OF = date(2001, 8, 2)
OPEN_SINCE = date(2001, 2, 3)
EPOCH = date(1995, 1, 1)
# Lineitems of one order and number are told apart by their place among these; those beyond are numbered from FURTHER on.
COPIES, FURTHER = 100_000, 1 << 59


# The columns the views need. Stating them saves a job per file that would only read the footers for the schema.
STAR = {
    "customer": "c_custkey bigint, c_name string, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_linenumber int, l_quantity double, l_returnflag string, "
    "l_linestatus string",
    "events": "event_id bigint, user_id bigint, event_type string",
}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.schema(STAR[table]).parquet(f"{sf_dir}/{table}.parquet")


def _tier() -> Column:
    segment = F.col("c_mktsegment")
    return (
        F.when(segment.isin("BUILDING", "MACHINERY"), "standard")
        .when(segment.isin("FURNITURE", "HOUSEHOLD"), "student")
        .otherwise("premium")
    )


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers; they joined when they first ordered, or else on a day that follows from their key."""
    key = F.col("c_custkey")
    first = (
        read(spark, sf_dir, "orders")
        .groupBy(F.col("o_custkey").alias("c_custkey"))
        .agg(F.min(F.col("o_orderdate").cast("date")).alias("first_order"))
    )
    joined = F.coalesce("first_order", F.date_add(F.lit(EPOCH), (key * 37 % 2400).cast("int")))
    df = read(spark, sf_dir, "customer").join(first, "c_custkey", "left").select(
        key.alias("member_id"),
        F.col("c_name").alias("full_name"),
        F.concat(F.lower("c_name"), F.lit("@example.com")).alias("email"),
        F.lit(None).cast("string").alias("phone"),
        joined.alias("join_date"),
        F.date_add(joined, (365 * (1 + key % 7)).cast("int")).alias("expiry_date"),
        _tier().alias("membership_type"),
        F.when(F.col("c_acctbal") < 0, "suspended")
        .when(F.col("c_acctbal") > 9000, "expired")
        .otherwise("active")
        .alias("status"),
    )
    return conform(df, "members")


def numbered_lines(spark: SparkSession, sf_dir: str, rule: HotRule = DEFAULT_RULE) -> DataFrame:
    """Every lineitem with a loan_id of its own, however many there are of one order and number.

    Where no order is hot, lines are dealt by their order once, for this and for the join with the orders.
    """
    keys = ["l_orderkey", "l_linenumber"]
    lines = read(spark, sf_dir, "lineitem")
    # Rows that tie in all of these are equal.
    order = ["l_partkey", "l_quantity", "l_returnflag", "l_linestatus"]
    first = (F.col("l_orderkey") * 10 + F.col("l_linenumber")) * COPIES
    if hot_keys(lines, keys[:1], HotRule(min(COPIES, rule.rows))).isEmpty():
        copy = F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1
        return lines.repartition("l_orderkey").select(*lines.columns, (first + copy).alias("loan_id"))
    # The last column only deals equal rows into chunks.
    rows, order = lines.withColumn("_row", F.monotonically_increasing_id()), [*order, "_row"]
    rows = grouped_window(rows, keys, order, row_number="copy", rule=rule).withColumn("copy", F.col("copy") - 1)
    loan_id = (first + F.col("copy")).alias("loan_id")
    if hot_keys(lines, keys, HotRule(COPIES)).isEmpty():
        return rows.select(*lines.columns, loan_id)
    near = rows.where(F.col("copy") < COPIES).select(*lines.columns, loan_id)
    far = grouped_window(rows.where(F.col("copy") >= COPIES), [], [*keys, "copy"], row_number="further", rule=rule)
    far = far.select(*lines.columns, (F.lit(FURTHER) + F.col("further")).alias("loan_id"))
    return near.unionByName(far)


def lent_lines(spark: SparkSession, sf_dir: str, rule: HotRule = DEFAULT_RULE) -> DataFrame:
    """Every lineitem as a loan, plus the return flag `rf` that fines and reservations are derived from."""
    lines = numbered_lines(spark, sf_dir, rule)
    tiers = read(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"), _tier().alias("membership_type")
    )
    orders = read(spark, sf_dir, "orders").join(tiers, "o_custkey").select(
        F.col("o_orderkey").alias("l_orderkey"),
        F.col("o_custkey").alias("member_id"),
        F.col("o_orderdate").cast("date").alias("loan_date"),
        "membership_type",
    )
    kept = F.date_add("loan_date", F.col("l_quantity").cast("int"))
    still_out = (F.col("l_linestatus") == "O") & (F.col("loan_date") >= F.lit(OPEN_SINCE))
    return lines.join(orders, "l_orderkey").select(
        "loan_id",
        F.col("l_partkey").alias("book_id"),
        "member_id",
        "loan_date",
        F.date_add("loan_date", c.loan_days()).alias("due_date"),
        F.when(still_out | (kept > F.lit(AS_OF)), F.lit(None).cast("date")).otherwise(kept).alias("return_date"),
        (F.col("l_linenumber") % 3).cast("short").alias("renewed_count"),
        F.col("l_returnflag").alias("rf"),
    )


def fines(lent: DataFrame) -> DataFrame:
    late = lent.where(F.col("return_date") > F.col("due_date"))
    paid = F.col("rf") == "A"
    df = late.select(
        F.col("loan_id").alias("fine_id"),
        "loan_id",
        "member_id",
        c.late_fee(F.datediff("return_date", "due_date")).alias("amount"),
        F.col("return_date").alias("issued_date"),
        paid.alias("paid"),
        F.when(paid, F.date_add("return_date", 5)).alias("paid_date"),
    )
    return conform(df, "fines")


def books(spark: SparkSession, sf_dir: str, lent: DataFrame) -> DataFrame:
    open_loans = lent.where(F.col("return_date").isNull()).groupBy("book_id").agg(F.count(F.lit(1)).alias("out"))
    total = 1 + F.col("p_size") % 5
    df = (
        read(spark, sf_dir, "part")
        .withColumnRenamed("p_partkey", "book_id")
        .join(open_loans, "book_id", "left")
        .select(
            "book_id",
            F.concat_ws("-", "p_brand", "p_type", "p_size").alias("isbn"),
            F.col("p_name").alias("title"),
            F.col("p_brand").alias("author"),
            F.col("p_type").alias("genre"),
            (1950 + F.col("p_size")).alias("year_published"),
            total.alias("total_copies"),
            F.greatest(total - F.coalesce("out", F.lit(0)), F.lit(0)).alias("available_copies"),
            F.lit(EPOCH).cast("timestamp_ntz").alias("added_at"),
        )
    )
    return conform(df, "books")


def reservations(lent: DataFrame) -> DataFrame:
    wanted = (
        lent.where(F.col("rf") == "R")
        .groupBy("book_id", "member_id")
        .agg(F.min("loan_id").alias("reservation_id"), F.min("loan_date").alias("reserved_date"))
    )
    queued = grouped_window(
        wanted,
        ["book_id"],
        ["reserved_date", "member_id"],
        row_number="queue_position",
    )
    return conform(queued.withColumn("notified", F.col("reservation_id") % 2 == 1), "reservations")


def library(spark: SparkSession, sf_dir: str) -> TableSet:
    """The library of one data folder as views; a table is planned when it is first asked for."""
    lent = cache(lambda: lent_lines(spark, sf_dir))
    return TableSet(
        books=lambda: books(spark, sf_dir, lent()),
        members=lambda: members(spark, sf_dir),
        loans=lambda: conform(lent(), "loans"),
        fines=lambda: fines(lent()),
        reservations=lambda: reservations(lent()),
    )


@cache
def stored_library(spark: SparkSession, sf_dir: str) -> TableSet:
    """The library of one data folder as parquet tables, written to the work folder when first asked for.

    Later queries of the session read what is written there. Each table has the whole content of its view.
    """
    folder = work_dir(spark)
    lent = cache(lambda: written(lent_lines(spark, sf_dir), f"{folder}/lent"))
    return TableSet(
        books=lambda: written(books(spark, sf_dir, lent()), f"{folder}/books"),
        members=lambda: written(members(spark, sf_dir), f"{folder}/members"),
        loans=lambda: conform(lent(), "loans"),
        fines=lambda: written(fines(lent()), f"{folder}/fines"),
        reservations=lambda: written(reservations(lent()), f"{folder}/reservations"),
    )
