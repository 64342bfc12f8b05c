"""Loans kept in the table store by a feed of issues and returns, every event exactly once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendframe.functions import columns as c
from lendframe.schema import conform
from lendframe.sources.table_store import Changes, TableStore


def loan_changes(events: DataFrame, loans: DataFrame, members: DataFrame) -> DataFrame:
    """The loans that a set of events adds or changes, as they are afterwards: events (loan_id, ts, book_id, member_id,
    action).

    An issue adds a loan, renewals put its due date off by the member's period, a return closes it. Of issues and of returns
    of one loan the first counts; events of loans that nobody issued, or of unknown members, change nothing. Events are
    summed up per loan before they meet the loans.
    """
    asked = events.groupBy("loan_id").agg(
        F.min(F.when(F.col("action") == "issue", F.struct(F.col("ts").cast("date").alias("day"), "book_id", "member_id"))).alias("issue"),
        F.min(F.when(F.col("action") == "return", F.col("ts").cast("date"))).alias("back"),
        F.count_if(F.col("action") == "renew").alias("renewals"),
    )
    tiers = members.select(F.col("member_id").alias("of_member"), c.loan_days().alias("days"))
    known = asked.join(loans.withColumnRenamed("loan_id", "known_id"), F.col("loan_id") == F.col("known_id"), "left")
    known = known.where("known_id IS NOT NULL OR issue IS NOT NULL")
    member = F.coalesce("member_id", "issue.member_id")
    known = known.withColumn("own_member", member).join(tiers, F.col("own_member") == F.col("of_member"))
    loan_date = F.coalesce("loan_date", "issue.day")
    due = F.coalesce("due_date", F.date_add(loan_date, F.col("days")))
    after = known.select(
        "loan_id",
        F.coalesce("book_id", "issue.book_id").alias("book_id"),
        F.col("own_member").alias("member_id"),
        loan_date.alias("loan_date"),
        F.date_add(due, (F.col("renewals") * F.col("days")).cast("int")).alias("due_date"),
        F.coalesce("return_date", "back").alias("return_date"),
        (F.coalesce("renewed_count", F.lit(0)) + F.col("renewals")).alias("renewed_count"),
    )
    return conform(after, "loans")


def keep_loans(store: TableStore, run: str) -> Callable[[DataFrame, int], None]:
    """A sink for `foreachBatch`. Each micro-batch is one change set of the store under the name of the run, so that a batch
    that is repeated after a failure, whether it had been committed or not, counts once."""

    def apply(events: DataFrame, batch: int) -> None:
        now = store.tables()
        store.apply((run, batch), loans=Changes(loan_changes(events, now.loans, now.members)))

    return apply


def run_ledger(feed: DataFrame, store: TableStore, folder: str, run: str = "ledger") -> None:
    """Process what is available of a feed with loan_id and bring the store's loans up to date."""
    query = (
        feed.writeStream.foreachBatch(keep_loans(store, run))
        .option("checkpointLocation", f"{folder}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
