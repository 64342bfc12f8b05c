"""Reports about fines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lendframe.functions import columns as c
from lendframe.functions.grouped import DEFAULT_RULE, HotRule, global_ranks, grouped_window
from lendframe.operators.loans import month_of
from lendframe.schema import MONEY, MONEY_SUM


def _paid_only(paid: bool):
    """Amount where the paid flag has the given value, 0 elsewhere."""
    return F.when(F.col("paid") == paid, F.col("amount")).otherwise(F.lit(0).cast(MONEY))


def fine_revenue_by_month(fines: DataFrame) -> DataFrame:
    return (
        fines.groupBy(month_of("issued_date").alias("first_day"))
        .agg(
            F.count("fine_id").alias("fines_issued"),
            F.sum("amount").alias("total_fined"),
            F.sum(_paid_only(True)).alias("collected"),
            F.sum(_paid_only(False)).alias("outstanding"),
        )
        .select(c.month_key("first_day").alias("month"), "fines_issued", "total_fined", "collected", "outstanding")
        .orderBy(F.desc("month"))
    )


def running_fines(
    fines: DataFrame, members: DataFrame, rule: HotRule = DEFAULT_RULE
) -> DataFrame:
    """Every fine with the member's running total in order of issue."""
    summed = grouped_window(
        fines.select("fine_id", "member_id", "issued_date", "amount"),
        ["member_id"],
        ["issued_date", "fine_id"],
        running_sum={"running_total": "amount"},
        rule=rule,
    )
    return (
        summed.join(members.select("member_id", "full_name"), "member_id")
        .orderBy("full_name", "issued_date", "fine_id")
        .select("full_name", "issued_date", F.col("amount").alias("fine_this_row"), "running_total")
    )


def fine_percentiles(fines: DataFrame, members: DataFrame, rule: HotRule = DEFAULT_RULE) -> DataFrame:
    """Quartile (1 = highest fined) and percentile of every fined member by total fines."""
    totals = fines.groupBy("member_id").agg(F.sum("amount").alias("total_fined"))
    cents = (F.col("total_fined") * 100).cast("long")
    ranked = global_ranks(totals.withColumn("_cents", cents), "_cents", "member_id", rule=rule)

    n, row = F.col("all_rows"), F.col("row_num")
    size, larger = F.call_function("div", n, F.lit(4)), n % 4
    head = larger * (size + 1)
    quartile = F.when(row <= head, F.call_function("div", row - 1, size + 1) + 1).otherwise(
        larger + F.call_function("div", row - 1 - head, F.nullif(size, F.lit(0).cast("long"))) + 1
    )
    percentile = F.coalesce(c.percentage(F.col("rows_below"), n - 1), F.lit(0.0))
    return (
        ranked.join(members.select("member_id", "full_name"), "member_id")
        .orderBy("row_num")
        .select("full_name", "total_fined", quartile.cast("int").alias("quartile"), percentile.alias("percentile"))
    )


def rolling_fine_revenue(fines: DataFrame, rows: int = 7) -> DataFrame:
    """Paid fines per day of issue with the sum over the last `rows` days that had any; one row per day."""
    daily = fines.where("paid").groupBy(F.col("issued_date").alias("day")).agg(F.sum("amount").alias("daily_amount"))
    frame = W.orderBy("day").rowsBetween(1 - rows, W.currentRow)
    rolling = F.sum("daily_amount").over(frame).cast(MONEY_SUM)
    return daily.select("day", "daily_amount", rolling.alias("rolling_7d_revenue")).orderBy("day")


def _with_names(fines: DataFrame, members: DataFrame, loans: DataFrame, books: DataFrame) -> DataFrame:
    """Fines with member and title. Loans only lend their book id, so titles join fines rather than all loans."""
    who = members.select(
        "member_id", F.col("full_name").alias("member_name"), F.col("email").alias("member_email")
    )
    what = books.select("book_id", F.col("title").alias("book_title"))
    return fines.join(loans.select("loan_id", "book_id"), "loan_id").join(what, "book_id").join(who, "member_id")


def fine_list(fines: DataFrame, members: DataFrame, loans: DataFrame, books: DataFrame) -> DataFrame:
    return (
        _with_names(fines, members, loans, books)
        .select("fine_id", "member_name", "book_title", "amount", "issued_date", "paid", "paid_date")
        .orderBy(F.desc("issued_date"), "fine_id")
    )


def unpaid_fine_list(fines: DataFrame, members: DataFrame, loans: DataFrame, books: DataFrame) -> DataFrame:
    return (
        _with_names(fines.where(~F.col("paid")), members, loans, books)
        .select("fine_id", "member_name", "member_email", "book_title", "amount", "issued_date")
        .orderBy(F.desc("amount"), "fine_id")
    )


def filter_fines(listed: DataFrame, show: str = "all", term: str = "") -> DataFrame:
    """Rows of `fine_list` by payment state (`all`, `paid`, `unpaid`) and a search text."""
    states = {"all": F.lit(True), "paid": F.col("paid"), "unpaid": ~F.col("paid")}
    return listed.where(states[show] & c.mentions(["member_name", "book_title"], term))


def fine_totals(fines: DataFrame) -> DataFrame:
    nothing = F.lit(0).cast(MONEY_SUM)
    return fines.agg(
        F.coalesce(F.sum(_paid_only(True)), nothing).alias("collected"),
        F.coalesce(F.sum(_paid_only(False)), nothing).alias("outstanding"),
    )
