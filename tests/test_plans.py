"""Physical plans: what reaches the scan, which joins and exchanges are there."""

import re
from datetime import date

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lendframe.functions.grouped import HotRule
from lendframe.operators import catalogue, fines, loans, overview, people, waitlist
from lendframe.sources.star_views import AS_OF, stored_library


@pytest.fixture(scope="module")
def t(spark, sf_dir):
    return stored_library(spark, sf_dir)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def formatted(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_year_filter_reaches_the_scan(t):
    text = formatted(people.members_joined_in_year(t.members, AS_OF))
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(join_date,2001-01-01\)", text)
    assert re.search(r"PushedFilters: \[.*LessThan\(join_date,2002-01-01\)", text)


def test_trend_filter_is_folded_and_pushed(t):
    text = formatted(loans.monthly_loan_trend(t.loans, AS_OF))
    assert "GreaterThanOrEqual(loan_date,2000-08-02)" in text


def test_overdue_reads_few_columns_with_pushed_filters(t):
    text = formatted(loans.overdue_loans(t.loans, t.members, t.books, AS_OF))
    assert re.search(r"PushedFilters: \[.*IsNull\(return_date\).*LessThan\(due_date,2001-08-02\)", text)
    schemas = re.findall(r"ReadSchema: struct<(.*)>", text)
    assert "loan_id:bigint,book_id:bigint,member_id:bigint,due_date:date,return_date:date" in schemas
    assert "member_id:bigint,full_name:string" in schemas and "book_id:bigint,title:string" in schemas


def test_never_borrowed_is_an_anti_join(t):
    assert "LeftAnti" in plan(catalogue.never_borrowed(t.books, t.loans))


def test_limits_are_top_n(t):
    assert "TakeOrderedAndProject" in plan(catalogue.top_borrowed(t.books, t.loans))
    assert "TakeOrderedAndProject" in plan(loans.top_overdue(t.loans, t.members, t.books, AS_OF))


def test_search_has_no_product(t):
    text = plan(overview.search(t.books, t.members, "%12%"))
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_no_report_has_a_cartesian_product(spark, sf_dir):
    from lendframe.plans.registry import _reports

    lib = stored_library(spark, sf_dir)
    for name, report in _reports().items():
        text = plan(report(lib))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def single_partition_inputs(df):
    """Row counts that went into exchanges with one output partition when the query ran."""
    query = df._jdf.queryExecution()
    df.collect()
    counts = []

    def walk(node):
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        if name.endswith("QueryStage"):
            return walk(node.plan())
        if name == "Exchange" and node.outputPartitioning().numPartitions() == 1:
            counts.append(node.metrics().apply("shuffleRecordsWritten").value())
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(query.executedPlan())
    return counts


def test_the_walk_sees_a_plain_window(spark):
    rows = spark.range(0, 50_000, 1, 4).select("id", F.row_number().over(W.orderBy("id")).alias("n"))
    assert single_partition_inputs(rows) == [50_000]


SOME_HOT = HotRule(rows=50)


@pytest.mark.parametrize("report", ["rank_members", "fine_percentiles", "running_fines", "borrow_gaps", "reservation_chain"])
def test_no_single_task_sees_the_rows(t, report):
    """With the hot path forced, windows bring at most some rows per chunk to a single partition."""
    df = {
        "rank_members": lambda: people.rank_members(t.members, t.loans, SOME_HOT),
        "fine_percentiles": lambda: fines.fine_percentiles(t.fines, t.members, SOME_HOT),
        "running_fines": lambda: fines.running_fines(t.fines, t.members, SOME_HOT),
        "borrow_gaps": lambda: people.borrow_gaps(t.loans, t.members, t.books, SOME_HOT),
        "reservation_chain": lambda: waitlist.reservation_chain(t.reservations, t.members, SOME_HOT),
    }[report]()
    assert all(n <= 64 for n in single_partition_inputs(df))


def test_skewed_join_is_split(spark, tmp_path):
    """A third of all loans on one book: adaptive execution splits that partition instead of giving it to one task."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        key = F.col("id")
        skewed = spark.range(0, 30_000, 1, 6).select(
            key.alias("loan_id"),
            F.when(key < 10_000, 0).otherwise(key).alias("book_id"),
            (key % 50).alias("member_id"),
            F.lit(date(2001, 1, 1)).alias("loan_date"),
            F.lit(date(2001, 1, 15)).alias("due_date"),
            F.lit(None).cast("date").alias("return_date"),
            F.lit(0).cast("short").alias("renewed_count"),
        )
        books = spark.range(30_000).select(key.alias("book_id"), key.cast("string").alias("title"))
        members = spark.range(50).select(
            key.alias("member_id"), key.cast("string").alias("full_name"), key.cast("string").alias("email")
        )
        df = loans.overdue_loans(skewed, members, books, AS_OF)
        assert df.count() == 30_000
        df.write.format("noop").mode("overwrite").save()
        df.collect()
        assert "skew=true" in df._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
