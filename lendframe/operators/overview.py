"""Counts, searches and lookups that span several tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendframe.functions import columns as c
from lendframe.schema import TableSet


def table_counts(lib: TableSet) -> DataFrame:
    counts = [df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("total")) for name, df in lib.items()]
    return reduce(DataFrame.unionByName, counts)


def dashboard_stats(lib: TableSet) -> DataFrame:
    """Books, members, open loans and unpaid fines in one row."""

    def measured(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"))

    parts = [
        measured(lib.books, "total_books"),
        measured(lib.members, "total_members"),
        measured(lib.loans.where(F.col("return_date").isNull()), "active_loans"),
        measured(lib.fines.where(~F.col("paid")), "unpaid_fines"),
    ]
    names = ["total_books", "total_members", "active_loans", "unpaid_fines"]
    return reduce(DataFrame.unionByName, parts).agg(
        *[F.sum(F.when(F.col("name") == name, F.col("n"))).alias(name) for name in names]
    )


def search(books: DataFrame, members: DataFrame, pattern: str) -> DataFrame:
    """Books and members whose texts match a LIKE pattern, labelled by kind."""

    def matching(df: DataFrame, kind: str, key: str, name: str, detail: str) -> DataFrame:
        hit = F.lower(name).like(pattern) | F.lower(detail).like(pattern)
        return df.where(hit).select(
            F.lit(kind).alias("result_type"),
            F.col(key).alias("id"),
            F.col(name).alias("name"),
            F.col(detail).alias("detail"),
        )

    return (
        matching(books, "book", "book_id", "title", "author")
        .unionByName(matching(members, "member", "member_id", "full_name", "email"))
        .orderBy("result_type", "name", "id")
    )


def multi_column_search(df: DataFrame, columns: list[str], term: str) -> DataFrame:
    """Rows with the text in any of the columns, ignoring case."""
    return df.where(c.mentions(columns, term))


def rows_for_keys(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of a table whose key occurs in `keys`: the point lookup, for many keys at once."""
    return table.join(keys.select(key), key, "left_semi")
