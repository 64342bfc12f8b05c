"""Reports about loans."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lendframe.functions import columns as c


def month_of(day: str) -> Column:
    return F.trunc(F.col(day), "MM")


def overdue_detail(loans: DataFrame, members: DataFrame, books: DataFrame, as_of: date) -> DataFrame:
    """Overdue loans with member contact and the fee so far, longest overdue first."""
    late = loans.where(c.overdue(as_of)).select("loan_id", "book_id", "member_id", "due_date")
    days = c.days_overdue(as_of)
    return (
        late.join(members, "member_id")
        .join(books, "book_id")
        .select(
            "loan_id",
            F.col("full_name").alias("member_name"),
            F.col("email").alias("member_email"),
            F.col("title").alias("book_title"),
            "due_date",
            days.alias("days_overdue"),
            c.late_fee(days).alias("fine_so_far"),
        )
        .orderBy(F.desc("days_overdue"), "loan_id")
    )


def overdue_loans(loans: DataFrame, members: DataFrame, books: DataFrame, as_of: date) -> DataFrame:
    return overdue_detail(loans, members, books, as_of).drop("member_email", "fine_so_far")


def top_overdue(loans: DataFrame, members: DataFrame, books: DataFrame, as_of: date, n: int = 5) -> DataFrame:
    """First n rows of `overdue_detail`, planned as one top-n rather than a full sort."""
    return overdue_detail(loans, members, books, as_of).limit(n)


def loan_list(loans: DataFrame, members: DataFrame, books: DataFrame, as_of: date) -> DataFrame:
    return (
        loans.join(books.select("book_id", F.col("title").alias("book_title")), "book_id")
        .join(members.select("member_id", F.col("full_name").alias("member_name")), "member_id")
        .select(
            "loan_id",
            "book_title",
            "member_name",
            "loan_date",
            "due_date",
            "return_date",
            "renewed_count",
            c.loan_status(as_of).alias("loan_status"),
        )
        .orderBy(F.desc("loan_date"), "loan_id")
    )


def member_history(
    loans: DataFrame, books: DataFrame, fines: DataFrame, as_of: date, wanted: DataFrame | None = None
) -> DataFrame:
    """Loans with status and fine, of the members in `wanted` or of all. A loan with two fines gives two rows."""
    if wanted is not None:
        loans = loans.join(wanted.select("member_id"), "member_id", "left_semi")
    fee = F.coalesce("amount", F.lit(0)).cast("decimal(8,2)")
    return (
        loans.join(books.select("book_id", "title", "genre"), "book_id")
        .join(fines.select("loan_id", "amount"), "loan_id", "left")
        .select(
            "member_id",
            "loan_id",
            "title",
            "genre",
            "loan_date",
            "due_date",
            "return_date",
            c.loan_status(as_of).alias("loan_status"),
            fee.alias("fine_amount"),
        )
        .orderBy("member_id", F.desc("loan_date"), "loan_id")
    )


def return_time_by_genre(loans: DataFrame, books: DataFrame) -> DataFrame:
    """Days kept of completed loans per genre. Summed per book first, so that books join one row each."""
    kept = F.datediff("return_date", "loan_date")
    per_book = (
        loans.where(F.col("return_date").isNotNull())
        .groupBy("book_id")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(kept).alias("days"),
            F.min(kept).alias("shortest"),
            F.max(kept).alias("longest"),
        )
    )
    return (
        per_book.join(books.select("book_id", "genre"), "book_id")
        .groupBy("genre")
        .agg(
            F.sum("n").alias("completed_loans"),
            c.integer_ratio(F.sum("days"), F.sum("n"), 1).alias("avg_days_kept"),
            F.min("shortest").alias("fastest_return"),
            F.max("longest").alias("slowest_return"),
        )
        .orderBy(F.desc("avg_days_kept"), "genre")
    )


def monthly_loan_trend(loans: DataFrame, as_of: date, months: int = 12) -> DataFrame:
    """Loans and distinct borrowers per month over the last months; the first month is partial."""
    since = F.add_months(F.lit(as_of), -months)
    return (
        loans.where(F.col("loan_date") >= since)
        .groupBy(month_of("loan_date").alias("first_day"))
        .agg(F.count(F.lit(1)).alias("loans_issued"), F.count_distinct("member_id").alias("unique_borrowers"))
        .select(c.month_key("first_day").alias("month"), "loans_issued", "unique_borrowers")
        .orderBy("month")
    )


def moving_avg_loans(loans: DataFrame, rows: int = 3) -> DataFrame:
    """Average of the last `rows` monthly counts. The window runs over one row per month."""
    monthly = loans.groupBy(month_of("loan_date").alias("first_day")).agg(F.count(F.lit(1)).alias("loan_count"))
    frame = W.orderBy("first_day").rowsBetween(1 - rows, W.currentRow)
    average = c.integer_ratio(F.sum("loan_count").over(frame), F.count("loan_count").over(frame), 1)
    return monthly.select(
        c.month_key("first_day").alias("month"), "loan_count", average.alias("rolling_3m_avg")
    ).orderBy("month")


def fine_forecast(
    loans: DataFrame, members: DataFrame, books: DataFrame, as_of: date, horizon: int = 7
) -> DataFrame:
    """Fees of overdue loans as of today and after `horizon` more days."""
    days = c.days_overdue(as_of)
    late = loans.where(c.overdue(as_of)).select("loan_id", "book_id", "member_id", "due_date")
    return (
        late.join(members, "member_id")
        .join(books, "book_id")
        .orderBy(F.asc("due_date"), "loan_id")
        .select(
            "full_name",
            "title",
            "due_date",
            days.alias("days_overdue"),
            c.late_fee(days).alias("fine_so_far"),
            c.late_fee(days + horizon).alias("fine_in_1_week"),
        )
    )
