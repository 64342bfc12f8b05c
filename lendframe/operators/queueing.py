"""Create, cancel and notify reservations, a whole request table at a time."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendframe.functions.grouped import DEFAULT_RULE, HotRule, grouped_window
from lendframe.operators import jobs
from lendframe.operators.jobs import JobResult, decided, first_per_key, first_reason, join_decisions, numbered_after
from lendframe.schema import TableSet, conform

PAIR = ["book_id", "member_id"]


def create_reservations(
    lib: TableSet, requests: DataFrame, as_of: date, rule: HotRule = DEFAULT_RULE
) -> JobResult:
    """Queue members for books: requests (seq, book_id, member_id). Availability plays no part.

    All requests of one member for one book share their checks; the first one gets the place.
    """
    known_books = lib.books.select("book_id", F.lit(True).alias("_book"))
    people = lib.members.select("member_id", "status")
    queued = lib.reservations.select(*PAIR).distinct().withColumn("_queued", F.lit(True))
    checked = (
        first_per_key(requests, *PAIR)
        .join(known_books, "book_id", "left")
        .join(people, "member_id", "left")
        .join(queued, PAIR, "left")
        .select(
            *PAIR,
            "first_seq",
            first_reason(
                (F.col("_book").isNull(), jobs.BOOK_NOT_FOUND),
                (F.col("status").isNull(), jobs.MEMBER_NOT_FOUND),
                (F.col("status") != "active", jobs.MEMBER_NOT_ACTIVE),
                (F.col("_queued"), jobs.ALREADY_RESERVED),
            ).alias("_reason"),
        )
    )
    granted = checked.where(F.col("_reason").isNull()).drop("_reason")
    outcomes = decided(
        join_decisions(requests, checked, PAIR),
        ["seq", *PAIR],
        F.coalesce(F.col("_reason"), first_reason((F.col("seq") != F.col("first_seq"), jobs.ALREADY_RESERVED))),
    )
    ends = lib.reservations.groupBy("book_id").agg(F.max("queue_position").alias("_end"))
    placed = grouped_window(
        granted, ["book_id"], ["first_seq"], row_number="_place", rule=rule
    ).join(ends, "book_id", "left")
    added = numbered_after(placed, "first_seq", lib.reservations, "reservation_id").select(
        "reservation_id",
        *PAIR,
        F.lit(as_of).alias("reserved_date"),
        (F.coalesce("_end", F.lit(0)) + F.col("_place")).alias("queue_position"),
        F.lit(False).alias("notified"),
    )
    state = lib.with_tables(reservations=lib.reservations.unionByName(conform(added, "reservations")))
    return JobResult(state, outcomes)


def cancel_reservations(
    lib: TableSet, requests: DataFrame, rule: HotRule = DEFAULT_RULE
) -> JobResult:
    """Remove reservations and close up the queues behind them: requests (seq, reservation_id).

    A place moves down by the cancelled places before it; gaps that were there already stay.
    """
    known = lib.reservations.select("reservation_id", F.lit(True).alias("_known"))
    asked = first_per_key(requests, "reservation_id").join(known, "reservation_id", "left")
    outcomes = decided(
        requests.join(asked, "reservation_id", "left"),
        ["seq", "reservation_id"],
        first_reason(
            (F.col("_known").isNull() | (F.col("seq") != F.col("first_seq")), jobs.RESERVATION_NOT_FOUND)
        ),
    )
    flagged = lib.reservations.join(
        asked.select("reservation_id", F.lit(1).alias("_hit")), "reservation_id", "left"
    ).withColumn("_gone", F.coalesce("_hit", F.lit(0)))
    shifted = grouped_window(
        flagged,
        ["book_id"],
        ["queue_position"],
        running_sum={"_shift": "_gone"},
        rule=rule,
    )
    left = shifted.where(F.col("_gone") == 0).withColumn("queue_position", F.col("queue_position") - F.col("_shift"))
    return JobResult(lib.with_tables(reservations=conform(left, "reservations")), outcomes)


def notify_reservations(lib: TableSet, requests: DataFrame) -> JobResult:
    """Mark reservations as notified: requests (seq, reservation_id)."""
    asked = first_per_key(requests, "reservation_id").join(
        lib.reservations.select("reservation_id", "notified"), "reservation_id", "left"
    )
    outcomes = decided(
        requests.join(asked, "reservation_id", "left"),
        ["seq", "reservation_id"],
        first_reason(
            (F.col("notified").isNull(), jobs.RESERVATION_NOT_FOUND),
            (F.col("notified") | (F.col("seq") != F.col("first_seq")), jobs.ALREADY_NOTIFIED),
        ),
    )
    told = asked.where(~F.col("notified")).select("reservation_id", F.lit(True).alias("_told"))
    marked = lib.reservations.join(told, "reservation_id", "left").withColumn(
        "notified", F.col("notified") | F.coalesce("_told", F.lit(False))
    )
    return JobResult(lib.with_tables(reservations=conform(marked, "reservations")), outcomes)
