"""Distinct borrowers of any span of months from one theta sketch per month.

Counting distinct members of a span exactly moves a row per member and span. A sketch is made once per month, keeps at most
about 2**`size` hashes, and is merged for any span. Up to 2**`size` distinct members a count is exact, above it the standard error is about
1 / sqrt(2**`size`), under one in a hundred for the default. Members that are null are not counted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendframe.functions import columns as c
from lendframe.operators.loans import month_of

SIZE = 14


def monthly_borrowers(loans: DataFrame, size: int = SIZE) -> DataFrame:
    """first_day, borrowers (a sketch), one row per month that has loans; sketches of parts of a month merge as well."""
    dated = loans.where(F.col("loan_date").isNotNull())
    return dated.groupBy(month_of("loan_date").alias("first_day")).agg(
        F.theta_sketch_agg("member_id", size).alias("borrowers")
    )


def borrowers_in_ranges(monthly: DataFrame, ranges: DataFrame, size: int = SIZE) -> DataFrame:
    """from_month, to_month, borrowers of each distinct range (first days of its first and last month); 0 if there are none
    and for a range that ends before it starts or has a null end."""
    ranges = ranges.select("from_month", "to_month").distinct()
    forward = F.when(F.col("from_month") <= F.col("to_month"), F.expr("sequence(from_month, to_month, interval 1 month)"))
    months = ranges.select("*", F.explode_outer(forward).alias("first_day"))
    found = months.join(monthly, "first_day", "left").groupBy("from_month", "to_month")
    return found.agg(F.theta_union_agg("borrowers", size).alias("all")).select(
        "from_month", "to_month", F.coalesce(F.theta_sketch_estimate("all"), F.lit(0)).cast("long").alias("borrowers")
    )


def trailing_borrowers(loans: DataFrame, spans: tuple[int, ...] = (3, 12), size: int = SIZE) -> DataFrame:
    """Distinct borrowers of the last 3 and 12 months up to each month with loans. Loans are read and shuffled once, as
    sketches; each goes on to the months whose spans hold it."""
    reach = F.array(*[F.struct(F.lit(n).alias("months"), F.lit(k).alias("ago")) for n in spans for k in range(n)])
    spread = monthly_borrowers(loans, size).select("first_day", "borrowers", F.inline(reach))
    return (
        spread.groupBy(F.add_months("first_day", F.col("ago")).alias("last"), "months")
        .agg(F.theta_union_agg("borrowers", size).alias("all"), F.min("ago").alias("nearest"))
        .where("nearest = 0")
        .select(c.month_key("last").alias("month"), "months", F.theta_sketch_estimate("all").alias("borrowers"))
    )
