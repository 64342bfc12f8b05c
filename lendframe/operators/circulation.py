"""Issue, return and renew loans and pay fines, a whole request table at a time.

Requests carry a unique `seq`; outcomes and state equal those of serving them one by one in that order.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendframe.functions import columns as c
from lendframe.functions.grouped import DEFAULT_RULE, HotRule, grouped_window
from lendframe.operators import jobs
from lendframe.operators.jobs import JobResult, decided, first_per_key, first_reason, join_decisions, numbered_after
from lendframe.schema import MAX_RENEWALS, TableSet, conform

PAIR = ["book_id", "member_id"]


def _shift_copies(books: DataFrame, moved: DataFrame, sign: int) -> DataFrame:
    """Change available copies by the number of rows in `moved` per book."""
    per_book = moved.groupBy("book_id").agg(F.count(F.lit(1)).alias("_moved"))
    change = F.coalesce("_moved", F.lit(0)) * sign
    df = books.join(per_book, "book_id", "left").withColumn("available_copies", F.col("available_copies") + change)
    return conform(df, "books")


def issue_loans(lib: TableSet, requests: DataFrame, as_of: date, rule: HotRule = DEFAULT_RULE) -> JobResult:
    """Lend books to members: requests (seq, book_id, member_id).

    All requests of one member for one book share their checks, which are made once per pair. In a batch of issues
    availability only falls, so of a pair only the first request can succeed, and it does if its place among the book's
    first requests is within the available copies.
    """
    people = lib.members.select("member_id", "status", "membership_type")
    held = lib.loans.where(F.col("return_date").isNull()).select(*PAIR).distinct().withColumn("_held", F.lit(True))
    checked = (
        first_per_key(requests, *PAIR)
        .join(people, "member_id", "left")
        .join(held, PAIR, "left")
        .select(
            *PAIR,
            "first_seq",
            c.loan_days().alias("_days"),
            first_reason(
                (F.col("status").isNull(), jobs.MEMBER_NOT_FOUND),
                (F.col("status") != "active", jobs.MEMBER_NOT_ACTIVE),
                (F.col("_held"), jobs.ALREADY_BORROWED),
            ).alias("_reason"),
        )
    )
    queued = grouped_window(
        checked.where(F.col("_reason").isNull()),
        ["book_id"],
        ["first_seq"],
        row_number="_place",
        rule=rule,
    ).join(lib.books.select("book_id", "available_copies"), "book_id", "left")
    placed = queued.withColumn("_granted", F.coalesce(F.col("_place") <= F.col("available_copies"), F.lit(False)))
    granted = placed.where("_granted").select(*PAIR, "first_seq", "_days")
    by_pair = (
        checked.where(F.col("_reason").isNotNull())
        .select(*PAIR, "first_seq", "_reason")
        .unionByName(
            placed.select(*PAIR, "first_seq", first_reason((~F.col("_granted"), jobs.NO_COPIES)).alias("_reason"))
        )
    )
    outcomes = decided(
        join_decisions(requests, by_pair, PAIR),
        ["seq", *PAIR],
        F.coalesce(F.col("_reason"), first_reason((F.col("seq") != F.col("first_seq"), jobs.ALREADY_BORROWED))),
    )
    issued = numbered_after(granted, "first_seq", lib.loans, "loan_id").select(
        "loan_id",
        *PAIR,
        F.lit(as_of).alias("loan_date"),
        F.date_add(F.lit(as_of), F.col("_days")).alias("due_date"),
        F.lit(None).alias("return_date"),
        F.lit(0).alias("renewed_count"),
    )
    state = lib.with_tables(
        loans=lib.loans.unionByName(conform(issued, "loans")),
        books=_shift_copies(lib.books, granted, -1),
    )
    return JobResult(state, outcomes)


def return_loans(lib: TableSet, requests: DataFrame, as_of: date) -> JobResult:
    """Take loans back: requests (seq, loan_id). Late returns get a fine dated on the return."""
    loans = lib.loans.select("loan_id", "book_id", "member_id", "due_date", "return_date")
    asked = first_per_key(requests, "loan_id").join(loans, "loan_id", "left")
    outcomes = decided(
        requests.join(asked, "loan_id", "left"),
        ["seq", "loan_id"],
        first_reason(
            (F.col("book_id").isNull(), jobs.LOAN_NOT_FOUND),
            (F.col("return_date").isNotNull() | (F.col("seq") != F.col("first_seq")), jobs.ALREADY_RETURNED),
        ),
    )
    returned = asked.where(F.col("book_id").isNotNull() & F.col("return_date").isNull())
    late = returned.where(F.col("due_date") < F.lit(as_of))
    fined = numbered_after(late, "first_seq", lib.fines, "fine_id").select(
        "fine_id",
        "loan_id",
        "member_id",
        c.late_fee(c.days_overdue(as_of)).alias("amount"),
        F.lit(as_of).alias("issued_date"),
        F.lit(False).alias("paid"),
        F.lit(None).alias("paid_date"),
    )
    closed = returned.select("loan_id", F.lit(as_of).alias("_closed"))
    state = lib.with_tables(
        loans=conform(
            lib.loans.join(closed, "loan_id", "left").withColumn("return_date", F.coalesce("return_date", "_closed")),
            "loans",
        ),
        fines=lib.fines.unionByName(conform(fined, "fines")),
        books=_shift_copies(lib.books, returned, 1),
    )
    return JobResult(state, outcomes)


def renew_loans(lib: TableSet, requests: DataFrame, rule: HotRule = DEFAULT_RULE) -> JobResult:
    """Extend loans by the member's period from the old due date: requests (seq, loan_id)."""
    turns = grouped_window(requests, ["loan_id"], ["seq"], row_number="_turn", rule=rule)
    tiers = lib.members.select("member_id", "membership_type")
    # A loan whose member is gone can't be renewed: neither decision nor state knows it.
    loans = lib.loans.select("loan_id", "member_id", "return_date", "renewed_count").join(tiers, "member_id")
    checked = turns.join(loans, "loan_id", "left")
    outcomes = decided(
        checked,
        ["seq", "loan_id"],
        first_reason(
            (F.col("member_id").isNull(), jobs.LOAN_NOT_FOUND),
            (F.col("return_date").isNotNull(), jobs.RETURNED_LOAN),
            (F.col("renewed_count") + F.col("_turn") > MAX_RENEWALS, jobs.MAX_RENEWALS_REACHED),
        ),
    )
    # How often a loan is renewed follows from the number of its requests; no need to go through the outcomes.
    asked = requests.groupBy("loan_id").agg(F.count(F.lit(1)).alias("_asked"))
    times = F.least(F.col("_asked"), F.greatest(F.lit(MAX_RENEWALS) - F.col("renewed_count"), F.lit(0)))
    extended = (
        asked.join(loans.where(F.col("return_date").isNull()), "loan_id")
        .select("loan_id", times.cast("int").alias("_times"), c.loan_days().alias("_days"))
    )
    more = F.coalesce("_times", F.lit(0))
    renewed = (
        lib.loans.join(extended, "loan_id", "left")
        .withColumn("due_date", F.date_add("due_date", more * F.coalesce("_days", F.lit(0))))
        .withColumn("renewed_count", F.col("renewed_count") + more)
    )
    return JobResult(lib.with_tables(loans=conform(renewed, "loans")), outcomes)


def pay_fines(lib: TableSet, requests: DataFrame, as_of: date) -> JobResult:
    """Settle fines: requests (seq, fine_id)."""
    asked = first_per_key(requests, "fine_id").join(lib.fines.select("fine_id", "paid"), "fine_id", "left")
    outcomes = decided(
        requests.join(asked, "fine_id", "left"),
        ["seq", "fine_id"],
        first_reason(
            (F.col("paid").isNull(), jobs.FINE_NOT_FOUND),
            (F.col("paid") | (F.col("seq") != F.col("first_seq")), jobs.ALREADY_PAID),
        ),
    )
    settled = asked.where(~F.col("paid")).select("fine_id", F.lit(as_of).alias("_settled"))
    paid = (
        lib.fines.join(settled, "fine_id", "left")
        .withColumn("paid", F.col("paid") | F.col("_settled").isNotNull())
        .withColumn("paid_date", F.coalesce("_settled", "paid_date"))
    )
    return JobResult(lib.with_tables(fines=conform(paid, "fines")), outcomes)
