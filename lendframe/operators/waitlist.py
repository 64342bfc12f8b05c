"""Reports about reservations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendframe.functions.grouped import DEFAULT_RULE, HotRule, grouped_window


def reservation_chain(
    reservations: DataFrame, members: DataFrame, rule: HotRule = DEFAULT_RULE
) -> DataFrame:
    """The unbroken queue of each book, walked from position 1 in steps of one, with the depth of each step.

    Positions are unique per book, so a reservation is reached exactly when as many positions exist up to it as its own
    number says. That turns the recursive walk into one numbering.
    """
    numbered = grouped_window(
        reservations.where(F.col("queue_position") >= 1),
        ["book_id"],
        ["queue_position"],
        row_number="depth",
        rule=rule,
    )
    return (
        numbered.where(F.col("depth") == F.col("queue_position"))
        .join(members.select("member_id", "full_name"), "member_id")
        .select(
            "reservation_id",
            "member_id",
            "full_name",
            "book_id",
            "queue_position",
            F.col("depth").cast("int").alias("depth"),
        )
        .orderBy("book_id", "queue_position")
    )


def reservation_list(reservations: DataFrame, members: DataFrame, books: DataFrame) -> DataFrame:
    return (
        reservations.join(books.select("book_id", F.col("title").alias("book_title")), "book_id")
        .join(
            members.select(
                "member_id", F.col("full_name").alias("member_name"), F.col("email").alias("member_email")
            ),
            "member_id",
        )
        .orderBy("book_id", "queue_position")
        .select(
            "reservation_id",
            "book_title",
            "member_name",
            "member_email",
            "reserved_date",
            "queue_position",
            "notified",
        )
    )
