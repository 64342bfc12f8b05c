"""Loans of lineitems: ids of their own, whatever the sizes of the groups."""

import pytest
from pyspark.sql import functions as F

from lendframe.functions.grouped import DEFAULT_RULE, HotRule
from lendframe.sources import star_views
from lendframe.sources.star_views import COPIES, lent_lines


@pytest.mark.parametrize("rule", [DEFAULT_RULE, HotRule(1000)])
def test_more_lines_of_one_order_and_number_than_places(spark, tmp_path, rule):
    """One number of an order has more lines than places, and the next number has lines of its own."""
    n = 2 * COPIES + 50_000
    hot = F.col("id") < n
    lines = spark.range(n + 2000).select(
        F.lit(7).cast("long").alias("l_orderkey"), (F.col("id") % 5).alias("l_partkey"),
        F.when(hot, 1).otherwise(2).alias("l_linenumber"), F.lit(3.0).alias("l_quantity"),
        F.lit("R").alias("l_returnflag"), F.lit("F").alias("l_linestatus"),
    )
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.sql("SELECT 7L AS o_orderkey, 1L AS o_custkey, TIMESTAMP_NTZ'1996-01-01' AS o_orderdate").write.parquet(
        f"{tmp_path}/orders.parquet"
    )
    spark.sql("SELECT 1L AS c_custkey, 'c' AS c_name, 0D AS c_acctbal, 'BUILDING' AS c_mktsegment").write.parquet(
        f"{tmp_path}/customer.parquet"
    )
    lent = lent_lines(spark, str(tmp_path), rule)
    total, ids, first = lent.agg(F.count("loan_id"), F.countDistinct("loan_id"), F.min("loan_id")).first()
    assert total == ids == n + 2000 and first == 71 * COPIES
    assert lent.where(F.col("loan_id").between(72 * COPIES, 73 * COPIES - 1)).count() == 2000
    assert {r.book_id: r["count"] for r in lent.groupBy("book_id").count().collect()} == {b: (n + 2000) // 5 for b in range(5)}


def test_lines_carry_only_their_own_columns(spark, sf_dir):
    """rows were dealt with a number of their own, which only chunks of hot orders need."""
    lines = star_views.numbered_lines(spark, sf_dir)
    assert "monotonically" not in lines._jdf.queryExecution().optimizedPlan().toString()
    assert lines.count() == lines.select("loan_id").distinct().count() == star_views.read(spark, sf_dir, "lineitem").count()
