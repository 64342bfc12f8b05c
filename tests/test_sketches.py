"""Distinct borrowers from merged sketches: exact while they hold all members, within their error above."""

import random
from datetime import date

import pytest

from lendframe.operators.sketches import borrowers_in_ranges, monthly_borrowers, trailing_borrowers


def lent(spark, rows):
    return spark.createDataFrame(rows, "loan_date date, member_id long, borrowers string, months int")


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(6)
    made = [(date(draw.choice([1999, 2000]), draw.choice([1, 2, 4, 7, 12]), draw.randint(1, 28)), draw.randint(1, 90)) for _ in range(700)]
    made += [(date(2000, 1, 31), None), (None, 5), (date(1999, 12, 31), 1), (date(1999, 12, 31), 1)]
    return [(d, m, "x", 1) for d, m in made]


def distinct(rows, first, last):
    return len({m for d, m, *_ in rows if d and m is not None and first <= d.year * 12 + d.month <= last})


def test_trailing_counts_are_exact_for_few_members(spark, rows):
    got = {(r.month[:7], r.months): r.borrowers for r in trailing_borrowers(lent(spark, rows)).collect()}
    there = {d.year * 12 + d.month: d.strftime("%Y-%m") for d, *_ in rows if d}
    assert got == {(name, n): distinct(rows, m - n + 1, m) for m, name in there.items() for n in (3, 12)}
    assert trailing_borrowers(lent(spark, [])).collect() == []


def test_any_range(spark, rows):
    ends = [(date(1999, 1, 1), date(2000, 12, 1)), (date(1999, 3, 1), date(1999, 3, 1)), (date(1999, 2, 1), date(1999, 7, 1))]
    odd = [(date(2000, 5, 1), date(1999, 5, 1)), (None, date(1999, 5, 1)), ends[0]]
    ranges = spark.createDataFrame([*ends, *odd], "from_month date, to_month date")
    got = {(r.from_month, r.to_month): r.borrowers for r in borrowers_in_ranges(monthly_borrowers(lent(spark, rows)), ranges).collect()}
    number = {e: e.year * 12 + e.month for pair in ends for e in pair}
    assert got == {(a, b): distinct(rows, number[a], number[b]) for a, b in ends} | {odd[0]: 0, odd[1]: 0}


def test_error_of_small_sketches(spark):
    """Sketches of 2**10 entries over 40,000 members in twelve overlapping months."""
    loans = spark.range(240_000).selectExpr(
        "add_months(date'2000-01-01', int(id % 12)) AS loan_date", "hash(id) % 40000 AS member_id"
    )
    exact = loans.selectExpr("count(DISTINCT member_id) AS n").first().n
    got = {r.month[:7]: r.borrowers for r in trailing_borrowers(loans, (12,), 10).collect()}
    assert abs(got["2000-12"] - exact) <= 4 * exact / 2**5
