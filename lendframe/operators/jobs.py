"""What the circulation and catalogue jobs share: result type, rejection reasons, id assignment."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendframe.functions.grouped import number_rows
from lendframe.schema import TableSet

# The reasons a request is turned down.
MEMBER_NOT_FOUND = "Member not found"
MEMBER_NOT_ACTIVE = "Member is not active"
ALREADY_BORROWED = "Member already has an active loan for this specific book."
NO_COPIES = "No copies currently available."
LOAN_NOT_FOUND = "Loan not found"
ALREADY_RETURNED = "Book already returned"
RETURNED_LOAN = "Cannot renew a returned loan"
MAX_RENEWALS_REACHED = "Maximum renewals reached"
FINE_NOT_FOUND = "Fine not found"
ALREADY_PAID = "Fine already paid"
BOOK_NOT_FOUND = "Book not found"
ALREADY_RESERVED = "Member already has a reservation for this book"
RESERVATION_NOT_FOUND = "Reservation not found"
ALREADY_NOTIFIED = "Already notified"
TOO_FEW_COPIES = "Cannot reduce total copies below currently issued copies."
MISSING_FIELD = "Required field missing"
BAD_NUMBER = "Invalid number"
BAD_DOMAIN = "Value outside its domain"
BAD_DATE = "Invalid date"
DUPLICATE_ISBN = "Duplicate isbn"
DUPLICATE_EMAIL = "Duplicate email"
HAS_OBLIGATIONS = "Member has open loans or unpaid fines"


@dataclass(frozen=True)
class JobResult:
    """New state and one outcome row (`accepted`, `reason`) per request."""

    state: TableSet
    outcomes: DataFrame


def first_reason(*checks: tuple[Column, str]) -> Column:
    """Reason of the first check that fires, NULL if none does; a NULL condition does not fire."""
    return F.coalesce(*[F.when(condition, F.lit(reason)) for condition, reason in checks])


def decided(df: DataFrame, keys: list[str], reason: Column) -> DataFrame:
    return df.select(*keys, reason.alias("reason")).select(
        *keys, F.col("reason").isNull().alias("accepted"), "reason"
    )


def first_per_key(requests: DataFrame, *key: str) -> DataFrame:
    """Lowest `seq` per key, combined on the map side, so a key repeated without end costs one row."""
    return requests.groupBy(*key).agg(F.min("seq").alias("first_seq"))


def join_decisions(requests: DataFrame, decisions: DataFrame, keys: list[str]) -> DataFrame:
    """Join requests with what was decided for their keys; a missing key value finds its decision as well."""
    theirs = decisions.withColumnsRenamed({k: f"_{k}" for k in keys})
    same = [requests[k].eqNullSafe(theirs[f"_{k}"]) for k in keys]
    return requests.join(theirs, same, "left").drop(*[f"_{k}" for k in keys])


def numbered_after(df: DataFrame, order: str, existing: DataFrame, key: str) -> DataFrame:
    """Give each row the next free integer key of a table, in `order`."""
    last = existing.agg(F.coalesce(F.max(key), F.lit(0)).cast("long")).scalar()
    return number_rows(df, order, "_n").withColumn(key, last + F.col("_n")).drop("_n")


def blank(column: str) -> Column:
    return F.col(column).isNull() | (F.trim(F.col(column)) == "")
