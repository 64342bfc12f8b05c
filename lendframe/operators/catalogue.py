"""Reports about books.

Joins are left to Catalyst: it broadcasts a side only below its size threshold and otherwise sorts and merges, where
adaptive execution splits skewed partitions. Facts are aggregated per key before they meet a dimension.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendframe.functions import columns as c
from lendframe.functions.grouped import grouped_window

# Fixed value: how many copies of one isbn are listed in one text cell before the list goes on in the next part.


def list_books(books: DataFrame) -> DataFrame:
    return books.select(
        "book_id", "title", "author", "isbn", "genre", "year_published", "total_copies", "available_copies"
    ).orderBy("title", "book_id")


def books_by_genre_or_title(books: DataFrame, genre: str, pattern: str) -> DataFrame:
    """Books of a genre followed by books whose title matches; a book that does both appears twice."""
    by_genre = books.where(F.col("genre") == genre)
    by_title = books.where(F.lower("title").like(pattern))
    shown = ["title", "author", "year_published"]
    return by_genre.select(*shown).unionByName(by_title.select(*shown))


def genre_counts(books: DataFrame) -> DataFrame:
    year = F.col("year_published")
    return (
        books.groupBy("genre")
        .agg(
            F.count(F.lit(1)).alias("total_books"),
            F.sum("total_copies").alias("total_copies"),
            c.integer_ratio(F.sum(year), F.count(year), 0).cast("int").alias("avg_pub_year"),
        )
        .orderBy(F.desc("total_books"), "genre")
    )


def loans_per_book(loans: DataFrame) -> DataFrame:
    return loans.groupBy("book_id").agg(F.count(F.lit(1)).alias("borrow_count"))


def top_borrowed(books: DataFrame, loans: DataFrame, n: int = 5) -> DataFrame:
    """The n most borrowed books; unborrowed books count as 0."""
    return (
        books.join(loans_per_book(loans), "book_id", "left")
        .select("book_id", "title", "author", F.coalesce("borrow_count", F.lit(0)).alias("borrow_count"))
        .orderBy(F.desc("borrow_count"), "book_id")
        .limit(n)
        .select("title", "author", "borrow_count")
    )


def never_borrowed(books: DataFrame, loans: DataFrame, since: date | None = None) -> DataFrame:
    """Books without a loan, or without one on or after the day `since`."""
    loans = loans if since is None else loans.where(F.col("loan_date") >= F.lit(since))
    return (
        books.join(loans.select("book_id"), "book_id", "left_anti")
        .select("book_id", "title", "author", "year_published")
        .orderBy("year_published", "book_id")
    )


def availability(books: DataFrame) -> DataFrame:
    total, left = F.col("total_copies"), F.col("available_copies")
    return (
        books.where(left > 0)
        .select(
            "book_id",
            "title",
            "author",
            "total_copies",
            "available_copies",
            (total - left).alias("copies_on_loan"),
            c.percentage(left, total).alias("availability_pct"),
        )
        .orderBy("availability_pct", "book_id")
    )


def available_books(books: DataFrame) -> DataFrame:
    return (
        books.where(F.col("available_copies") > 0)
        .select("book_id", "title", "author", "genre", "available_copies", "total_copies")
        .orderBy("title", "book_id")
    )


def issuable_books(books: DataFrame) -> DataFrame:
    """Every book for the issue form, with a flag on those that cannot be picked."""
    return books.select(
        "book_id", "title", "available_copies", (F.col("available_copies") < 1).alias("taken")
    ).orderBy("title", "book_id")


def above_average_books(books: DataFrame, loans: DataFrame) -> DataFrame:
    """Books borrowed more often than the mean over borrowed books, compared on integers."""
    counts = loans_per_book(loans)
    mean = counts.agg(F.struct(F.sum("borrow_count").alias("loans"), F.count(F.lit(1)).alias("books"))).scalar()
    popular = counts.where(F.col("borrow_count") * mean["books"] > mean["loans"])
    return (
        books.join(popular, "book_id")
        .select("book_id", "title", "author", "genre", "borrow_count")
        .orderBy(F.desc("borrow_count"), "book_id")
        .select("title", "author", "genre", "borrow_count")
    )


def genre_by_quarter(loans: DataFrame, books: DataFrame, as_of: date) -> DataFrame:
    """Loans of the year per genre and quarter, counted per book first so that books join one row each."""
    quarters = [F.count_if(F.quarter("loan_date") == q).alias(f"q{q}") for q in (1, 2, 3, 4)]
    per_book = (
        loans.where(c.in_year("loan_date", as_of.year))
        .groupBy("book_id")
        .agg(*quarters, F.count(F.lit(1)).alias("annual_total"))
    )
    sums = [F.sum(name).alias(name) for name in ("q1", "q2", "q3", "q4", "annual_total")]
    return per_book.join(books, "book_id").groupBy("genre").agg(*sums).orderBy(F.desc("annual_total"), "genre")


def duplicate_isbns(books: DataFrame) -> DataFrame:
    """The books of isbns that several books carry, numbered within their isbn by id. One row per book."""
    counts = (
        books.groupBy("isbn").agg(F.count(F.lit(1)).alias("duplicate_count")).where(F.col("duplicate_count") > 1)
    )
    repeated = books.select("isbn", "book_id", "title").join(counts, "isbn")
    return (
        grouped_window(repeated, ["isbn"], ["book_id"], row_number="position")
        .select("isbn", "duplicate_count", "position", "book_id", "title")
        .orderBy(F.desc("duplicate_count"), "isbn", "position")
    )
