"""Column expressions shared by the reports and jobs. All stay inside whole-stage code generation."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from lendframe.schema import FINE_PER_DAY, LOAN_DAYS, MONEY


def in_year(day: str, year: int) -> Column:
    """Half-open date range, which reaches the parquet scan as a pushed filter (`year(day) = y` would not)."""
    return (F.col(day) >= F.lit(date(year, 1, 1))) & (F.col(day) < F.lit(date(year + 1, 1, 1)))


def month_key(day: str) -> Column:
    """First day of the month as text, such as `2024-03-01`."""
    return F.date_format(F.col(day), "yyyy-MM-01")


def month_index(day: str) -> Column:
    """Months since year 0: consecutive months differ by exactly one."""
    return F.year(day) * 12 + F.month(day)


def integer_ratio(numerator: Column, denominator: Column, decimals: int) -> Column:
    """`numerator / denominator` rounded half up, computed on integers so that engines cannot differ at .5.

    Both arguments are non-negative integers; a zero denominator gives NULL.
    """
    scale = 10**decimals
    num = numerator.cast("long") * F.lit(2 * scale)
    den = F.nullif(denominator.cast("long"), F.lit(0).cast("long"))
    scaled = F.call_function("div", num + den, den * F.lit(2))
    return scaled if decimals == 0 else scaled.cast("double") / F.lit(float(scale))


def percentage(part: Column, whole: Column) -> Column:
    """Percentage with one decimal, rounded half up."""
    return integer_ratio(part.cast("long") * F.lit(100), whole, 1)


def overdue(as_of: date) -> Column:
    """Open loans past their due date; both conditions are pushed to the loans scan."""
    return F.col("return_date").isNull() & (F.col("due_date") < F.lit(as_of))


def days_overdue(as_of: date) -> Column:
    return F.datediff(F.lit(as_of), F.col("due_date"))


def late_fee(days: Column) -> Column:
    return (days * F.lit(FINE_PER_DAY)).cast(MONEY)


def loan_status(as_of: date) -> Column:
    return (
        F.when(F.col("return_date").isNotNull(), "Returned")
        .when(F.col("due_date") < F.lit(as_of), "Overdue")
        .otherwise("Active")
    )


def loan_days(tier: str | Column = "membership_type") -> Column:
    """Loan period of a membership tier; an unknown tier gets the standard period."""
    tier = F.col(tier) if isinstance(tier, str) else tier
    return (
        F.when(tier == "premium", LOAN_DAYS["premium"])
        .when(tier == "student", LOAN_DAYS["student"])
        .otherwise(LOAN_DAYS["standard"])
    )


def mentions(columns: list[str], term: str) -> Column:
    """Case-insensitive substring match in any of the columns; NULL counts as empty text."""
    needle = F.lower(F.lit(term))
    match = F.lit(False)
    for name in columns:
        match = match | F.contains(F.lower(F.coalesce(F.col(name), F.lit(""))), needle)
    return match
