"""Batch jobs against serving the same requests one by one; one book and one loan get a third of all requests."""

import random
from datetime import date, timedelta
from decimal import Decimal

import pytest

from lendframe.functions.grouped import HotRule
from lendframe.operators import circulation, queueing
from tests import serial
from tests.builders import dicts, library, requests

TODAY = date(2024, 3, 1)
RULES = [HotRule(rows=5), HotRule(rows=0)]
STEP = 2**19  # spreads few requests over many blocks of 2**20


def same(df, rows, key):
    assert sorted(dicts(df), key=lambda r: r[key]) == sorted(rows, key=lambda r: r[key])


def same_outcomes(result, expected):
    assert {r.seq: r.reason for r in result.outcomes.collect()} == expected
    assert all(r.accepted == (r.reason is None) for r in result.outcomes.collect())


@pytest.fixture(scope="module")
def lib(spark):
    rnd = random.Random(11)
    tiers, states = ["standard", "student", "premium"], ["active", "active", "active", "suspended"]
    loans = []
    for i in range(60):
        due = TODAY + timedelta(days=rnd.randint(-20, 20))
        back = TODAY - timedelta(days=3) if rnd.random() < 0.3 else None
        loans.append({"book_id": rnd.randint(1, 8), "member_id": i % 20 + 1, "due_date": due, "return_date": back,
                      "renewed_count": rnd.randint(0, 2)})
    queue = [{"book_id": b, "member_id": m, "queue_position": m if m < 5 else m + 2}
             for b, n in [(1, 12), (2, 3), (3, 1)] for m in range(1, n + 1)]
    small = library(
        spark,
        books=[{"total_copies": 30, "available_copies": 12 if i == 0 else rnd.randint(0, 4)} for i in range(8)],
        members=[{"membership_type": rnd.choice(tiers), "status": rnd.choice(states)} for _ in range(30)],
        loans=loans,
        fines=[{"loan_id": i + 1, "paid": i % 3 == 0, "amount": Decimal(i + 1)} for i in range(12)],
        reservations=[{**r, "notified": r["member_id"] % 2 == 0} for r in queue],
    )
    return small.with_tables(**{n: df.cache() for n, df in small.items()})


@pytest.fixture(scope="module")
def pairs():
    rnd = random.Random(5)
    return [(i * STEP, 1 if rnd.random() < 0.4 else rnd.randint(1, 10), rnd.randint(1, 33)) for i in range(300)] + [
        (300 * STEP, None, 1), (301 * STEP, 1, None), (302 * STEP, None, None), (303 * STEP, None, 1)
    ]


@pytest.mark.parametrize("rule", RULES)
def test_issue(spark, lib, pairs, rule):
    asked = requests(spark, "seq long, book_id long, member_id long", pairs)
    result = circulation.issue_loans(lib, asked, TODAY, rule)
    outcomes, loans, books = serial.issue(dicts(lib.books), dicts(lib.members), dicts(lib.loans), pairs, TODAY)
    same_outcomes(result, outcomes)
    same(result.state.loans, loans, "loan_id")
    same(result.state.books, books, "book_id")
    assert result.state.books.where("available_copies < 0").isEmpty()
    assert len(set(outcomes.values())) == 5


def test_return(spark, lib):
    rnd = random.Random(2)
    rows = [(i * STEP, 3 if rnd.random() < 0.3 else rnd.randint(1, 66)) for i in range(80)]
    result = circulation.return_loans(lib, requests(spark, "seq long, loan_id long", rows), TODAY)
    outcomes, loans, fines, books = serial.give_back(
        dicts(lib.books), dicts(lib.loans), dicts(lib.fines), rows, TODAY
    )
    same_outcomes(result, outcomes)
    same(result.state.loans, loans, "loan_id")
    same(result.state.fines, fines, "fine_id")
    same(result.state.books, books, "book_id")


@pytest.mark.parametrize("rule", RULES)
def test_renew(spark, lib, rule):
    rnd = random.Random(4)
    rows = [(i * STEP, 7 if rnd.random() < 0.3 else rnd.randint(1, 66)) for i in range(90)]
    result = circulation.renew_loans(lib, requests(spark, "seq long, loan_id long", rows), rule)
    outcomes, loans = serial.renew(dicts(lib.members), dicts(lib.loans), rows)
    same_outcomes(result, outcomes)
    same(result.state.loans, loans, "loan_id")
    assert len(set(outcomes.values())) == 4


def test_pay(spark, lib):
    rows = [(i, i % 14 + 1) for i in range(30)]
    result = circulation.pay_fines(lib, requests(spark, "seq long, fine_id long", rows), TODAY)
    outcomes, fines = serial.pay(dicts(lib.fines), rows, TODAY)
    same_outcomes(result, outcomes)
    same(result.state.fines, fines, "fine_id")


@pytest.mark.parametrize("rule", RULES)
def test_reserve(spark, lib, pairs, rule):
    asked = requests(spark, "seq long, book_id long, member_id long", pairs)
    result = queueing.create_reservations(lib, asked, TODAY, rule)
    outcomes, queue = serial.reserve(dicts(lib.books), dicts(lib.members), dicts(lib.reservations), pairs, TODAY)
    same_outcomes(result, outcomes)
    same(result.state.reservations, queue, "reservation_id")
    assert len(set(outcomes.values())) == 5


@pytest.mark.parametrize("rule", RULES)
def test_cancel_keeps_old_gaps(spark, lib, rule):
    rows = list(enumerate([2, 5, 5, 8, 9, 13, 99, 16, 1]))
    asked = requests(spark, "seq long, reservation_id long", rows)
    result = queueing.cancel_reservations(lib, asked, rule)
    outcomes, queue = serial.cancel(dicts(lib.reservations), rows)
    same_outcomes(result, outcomes)
    same(result.state.reservations, queue, "reservation_id")


def test_notify(spark, lib):
    rows = list(enumerate([1, 2, 2, 3, 3, 40]))
    result = queueing.notify_reservations(lib, requests(spark, "seq long, reservation_id long", rows))
    outcomes, queue = serial.notify(dicts(lib.reservations), rows)
    same_outcomes(result, outcomes)
    same(result.state.reservations, queue, "reservation_id")


def test_overdue_loans_may_be_renewed_and_expired_cards_may_borrow(spark):
    old = library(
        spark, books=[{"total_copies": 2}], members=[{"expiry_date": date(2000, 1, 1)}, {}],
        loans=[{"member_id": 2, "due_date": date(2024, 1, 1)}],
    )
    lent = circulation.issue_loans(old, requests(spark, "seq long, book_id long, member_id long", [(1, 1, 1)]), TODAY)
    assert [r.accepted for r in lent.outcomes.collect()] == [True]
    renewed = circulation.renew_loans(old, requests(spark, "seq long, loan_id long", [(1, 1)]))
    assert [r.due_date for r in renewed.state.loans.collect()] == [date(2024, 1, 15)]
