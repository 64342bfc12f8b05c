"""Issues, renewals and returns decided in order, one book at a time.

The rules touch only a book's copies and its open loans, so books are independent. Within a book the outcome of an event
depends on all earlier ones; this is the one place where rows go through Python, batched by Arrow, over keyed state.
"""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lendframe.functions import columns as c
from lendframe.schema import MONEY
from lendframe.streaming import desk

DECISIONS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("book_id", T.LongType()),
        T.StructField("member_id", T.LongType()),
        T.StructField("action", T.StringType()),
        T.StructField("accepted", T.BooleanType()),
        T.StructField("reason", T.StringType()),
        T.StructField("due_date", T.DateType()),
        T.StructField("fine", MONEY),
    ]
)


# Workers get the processor's code along with the query; they do not import this package.
cloudpickle.register_pickle_by_value(desk)


def circulation_stream(
    feed: DataFrame, books: DataFrame, members: DataFrame, loans: DataFrame | None = None
) -> DataFrame:
    """Decisions on a feed of issue, renew and return events, in append mode.

    A book starts with its available copies and with the open loans among `loans`, if given; a member has at most one
    open loan of a book. Events are served by (ts, event_id) inside a micro-batch, stragglers when they arrive. Needs the
    RocksDB state store. The feed's files-per-batch setting bounds what one book can bring to one task.
    """
    held = None
    if loans is not None:
        held = loans.where(F.col("return_date").isNull()).select("book_id", "member_id", "due_date", "renewed_count")
    shelf = books.select("book_id", F.col("available_copies").alias("copies"))
    people = members.select("member_id", "status", c.loan_days().alias("days"))
    asked = (
        feed.join(shelf, "book_id", "left")
        .join(people, "member_id", "left")
        .select(
            "event_id",
            "book_id",
            "member_id",
            "action",
            "ts",
            F.col("ts").cast("date").alias("day"),
            F.coalesce("copies", F.lit(0)).alias("copies"),
            "status",
            F.coalesce("days", F.lit(0)).alias("days"),
        )
    )
    return asked.groupBy("book_id").transformWithStateInPandas(
        statefulProcessor=desk.BookDesk(),
        outputStructType=DECISIONS,
        outputMode="append",
        timeMode="none",
        initialState=held.groupBy("book_id") if held is not None else None,
    )
