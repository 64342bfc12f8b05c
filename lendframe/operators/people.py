"""Reports about members."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lendframe.functions import columns as c
from lendframe.functions.grouped import DEFAULT_RULE, HotRule, global_ranks, grouped_window
from lendframe.functions.pairs import pairs_within
from lendframe.operators.loans import month_of


def active_members(members: DataFrame, as_of: date) -> DataFrame:
    return (
        members.where((F.col("status") == "active") & (F.col("expiry_date") >= F.lit(as_of)))
        .select("member_id", "full_name", "email", "membership_type", "expiry_date")
        .orderBy("expiry_date", "member_id")
    )


def members_joined_in_year(members: DataFrame, as_of: date) -> DataFrame:
    return (
        members.where(c.in_year("join_date", as_of.year))
        .orderBy(F.desc("join_date"), "member_id")
        .select("full_name", "email", "join_date", "membership_type")
    )


def member_list(members: DataFrame) -> DataFrame:
    return members.orderBy("full_name", "member_id")


def eligible_members(members: DataFrame) -> DataFrame:
    """Members offered by the issue and reserve forms. The expiry date is not looked at."""
    return members.where(F.col("status") == "active").select("member_id", "full_name", "membership_type")


def members_with_unpaid_fines(members: DataFrame, fines: DataFrame) -> DataFrame:
    owed = (
        fines.where(~F.col("paid"))
        .groupBy("member_id")
        .agg(F.count(F.lit(1)).alias("open_fines"), F.sum("amount").alias("total_owed"))
        .where(F.col("total_owed") > 0)
    )
    return (
        members.select("member_id", "full_name", "email")
        .join(owed, "member_id")
        .orderBy(F.desc("total_owed"), "member_id")
    )


def members_overdue_more_than(loans: DataFrame, members: DataFrame, as_of: date, k: int = 3) -> DataFrame:
    late = (
        loans.where(c.overdue(as_of))
        .groupBy("member_id")
        .agg(F.count(F.lit(1)).alias("overdue_count"))
        .where(F.col("overdue_count") > k)
    )
    return (
        members.join(late, "member_id")
        .orderBy(F.desc("overdue_count"), "member_id")
        .select("full_name", "email", "phone", "overdue_count")
    )


def members_with_all_genres(members: DataFrame, loans: DataFrame, books: DataFrame) -> DataFrame:
    """Members who borrowed from every genre in the catalogue; everyone, if the catalogue has no genre."""
    all_genres = books.agg(F.count_distinct("genre")).scalar()
    seen = (
        loans.select("member_id", "book_id")
        .distinct()
        .join(books.select("book_id", "genre"), "book_id")
        .groupBy("member_id")
        .agg(F.count_distinct("genre").alias("genres"))
    )
    return (
        members.join(seen, "member_id", "left")
        .where(F.coalesce("genres", F.lit(0)) == all_genres)
        .select("member_id", "full_name")
    )


def shared_borrowers(
    loans: DataFrame, members: DataFrame, books: DataFrame, rule: HotRule = DEFAULT_RULE
) -> DataFrame:
    """Every borrower of a book with the number of its other borrowers, and of those with a higher member id.

    The second number counts each pair of borrowers once. One row per book and borrower, however many pairs there are;
    `borrower_pairs` lists the pairs themselves for chosen books.
    """
    borrowers = loans.select("book_id", "member_id").distinct()
    placed = grouped_window(borrowers, ["book_id"], ["member_id"], row_number="_place", rule=rule)
    sizes = borrowers.groupBy("book_id").agg(F.count(F.lit(1)).alias("_all"))
    return (
        placed.join(sizes, "book_id")
        .join(members.select("member_id", "full_name"), "member_id")
        .join(books.select("book_id", F.col("title").alias("shared_book")), "book_id")
        .select(
            "book_id",
            "shared_book",
            "member_id",
            "full_name",
            (F.col("_all") - 1).alias("co_borrowers"),
            (F.col("_all") - F.col("_place")).alias("later_co_borrowers"),
        )
    )


def borrower_pairs(loans: DataFrame, members: DataFrame, books: DataFrame, cell_rows: int = 20_000) -> DataFrame:
    """Distinct (member_1, member_2, title) where member_1 has the smaller id and both borrowed the same book.

    Loans collapse to one row per book and borrower name, with that name's smallest and largest id: a pair of names
    qualifies exactly when the smallest id of the one is below the largest id of the other. The report is the pair list
    itself, so its size is quadratic in a book's borrowers; the pairing of one book is spread over a grid of tasks.
    """
    borrowers = (
        loans.select("book_id", "member_id")
        .distinct()
        .join(members.select("member_id", "full_name"), "member_id")
        .groupBy("book_id", "full_name")
        .agg(F.min("member_id").alias("low"), F.max("member_id").alias("high"))
    )
    first = borrowers.select("book_id", F.col("full_name").alias("member_1"), "low")
    second = borrowers.select("book_id", F.col("full_name").alias("member_2"), "high")
    titled = books.select("book_id", F.col("title").alias("shared_book"))
    return (
        pairs_within(first, second, "book_id", "member_1", "member_2", cell_rows)
        .where(F.col("low") < F.col("high"))
        .join(titled, "book_id")
        .select("member_1", "member_2", "shared_book")
        .distinct()
    )


def rank_members(members: DataFrame, loans: DataFrame, rule: HotRule = DEFAULT_RULE) -> DataFrame:
    """Members ranked by number of loans, those without a loan included."""
    counts = loans.groupBy("member_id").agg(F.count(F.lit(1)).alias("total_loans"))
    totals = members.select("member_id", "full_name").join(counts, "member_id", "left").select(
        "member_id", "full_name", F.coalesce("total_loans", F.lit(0)).alias("total_loans")
    )
    return (
        global_ranks(totals, "total_loans", "member_id", rule=rule)
        .orderBy("row_num")
        .select("full_name", "total_loans", "rank_with_gaps", "rank_no_gaps", "row_num")
    )


def first_last_book(loans: DataFrame, members: DataFrame, books: DataFrame) -> DataFrame:
    """First and latest title per member; on a tied day the lower loan id counts for both."""
    ends = loans.groupBy("member_id").agg(
        F.min(F.struct("loan_date", "loan_id", "book_id"))["book_id"].alias("first_id"),
        F.max(F.struct("loan_date", (-F.col("loan_id")).alias("lower"), "book_id"))["book_id"].alias("latest_id"),
    )
    titles = books.select("book_id", "title")
    first = titles.select(F.col("book_id").alias("first_id"), F.col("title").alias("first_book"))
    latest = titles.select(F.col("book_id").alias("latest_id"), F.col("title").alias("latest_book"))
    return (
        ends.join(first, "first_id")
        .join(latest, "latest_id")
        .join(members.select("member_id", "full_name"), "member_id")
        .select("full_name", "first_book", "latest_book")
        .distinct()
    )


def borrow_gaps(
    loans: DataFrame, members: DataFrame, books: DataFrame, rule: HotRule = DEFAULT_RULE
) -> DataFrame:
    """Each loan with the same member's previous loan date and the days between."""
    lagged = grouped_window(
        loans.select("loan_id", "book_id", "member_id", "loan_date"),
        ["member_id"],
        ["loan_date", "loan_id"],
        lag={"prev_loan_date": "loan_date"},
        rule=rule,
    )
    return (
        lagged.join(members.select("member_id", "full_name"), "member_id")
        .join(books.select("book_id", "title"), "book_id")
        .orderBy("full_name", "loan_date", "loan_id")
        .select(
            "full_name",
            "loan_date",
            "title",
            "prev_loan_date",
            F.datediff("loan_date", "prev_loan_date").alias("days_since_prev_loan"),
        )
    )


def cohort_retention(members: DataFrame, loans: DataFrame) -> DataFrame:
    """Share of each monthly join cohort with a loan in the 13th to 15th month after the cohort month.

    The window of the rule starts and ends on month borders, so a member's loans reduce to their distinct months before
    they meet the member's cohort.
    """
    cohort = members.where(F.col("join_date").isNotNull()).select(
        "member_id", c.month_key("join_date").alias("cohort_month"), c.month_index("join_date").alias("joined")
    )
    months = loans.select("member_id", c.month_index("loan_date").alias("borrowed")).distinct()
    since = F.col("borrowed") - F.col("joined")
    returned = (
        months.join(cohort.select("member_id", "joined"), "member_id")
        .where((since >= 12) & (since < 15))
        .select("member_id", F.lit(1).alias("hit"))
        .distinct()
    )
    return (
        cohort.join(returned, "member_id", "left")
        .groupBy("cohort_month")
        .agg(F.count(F.lit(1)).alias("cohort_size"), F.count("hit").alias("still_active"))
        .withColumn("retention_pct", c.percentage(F.col("still_active"), F.col("cohort_size")))
        .orderBy("cohort_month")
    )


def consecutive_month_members(loans: DataFrame, minimum: int = 2) -> DataFrame:
    """Members with at least `minimum` pairs of adjacent months with a loan.

    After the distinct, a member has at most one row per calendar month, which bounds every window group.
    """
    months = loans.select("member_id", month_of("loan_date").alias("loan_month")).distinct()
    index = c.month_index("loan_month")
    previous = F.lag(index).over(W.partitionBy("member_id").orderBy("loan_month"))
    return (
        months.withColumn("adjacent", index - previous == 1)
        .groupBy("member_id")
        .agg(F.count_if("adjacent").alias("consecutive_months"))
        .where(F.col("consecutive_months") >= minimum)
        .orderBy(F.desc("consecutive_months"), "member_id")
    )
