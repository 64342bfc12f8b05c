"""Catalogue and member upkeep, audits after deletions, and audits on broken tables."""

from datetime import date, timedelta
from decimal import Decimal

import pytest

from lendframe.operators import jobs, quality, upkeep
from tests.builders import library, requests

TODAY = date(2024, 3, 1)
BOOK_FORM = "seq long, isbn string, title string, author string, genre string, year_published string, total_copies int"
BOOK_CHANGE = BOOK_FORM.replace("isbn string", "book_id long")
MEMBER_FORM = (
    "seq long, full_name string, email string, phone string, expiry_date string, membership_type string, status string"
)


def reasons(result):
    return [r.reason for r in result.outcomes.orderBy("seq").collect()]


def test_add_books(spark, lib):
    rows = [
        (1, "n1", "T", "A", "G", "", None),
        (2, "n1", "T", "A", "G", "1999", 3),
        (3, "n2", None, "A", "G", "1999", 3),
        (4, "n3", "T", "A", "G", "soon", 3),
        (5, "9780743477123", "T", "A", "G", "1999", 3),
        (6, "n2", "T", "A", "G", " 1999 ", 3),
        (7, "n4", "T", "A", "G", "-5", 3),
    ]
    result = upkeep.add_books(lib, requests(spark, BOOK_FORM, rows), TODAY)
    assert reasons(result) == [
        None, jobs.DUPLICATE_ISBN, jobs.MISSING_FIELD, jobs.BAD_NUMBER, jobs.DUPLICATE_ISBN, None, jobs.BAD_NUMBER
    ]
    new = result.state.books.where("book_id > 15").orderBy("book_id").collect()
    assert [(r.book_id, r.isbn, r.year_published, r.total_copies, r.available_copies) for r in new] == [
        (16, "n1", None, 1, 1), (17, "n2", 1999, 3, 3)
    ]


def test_add_members(spark, lib):
    rows = [
        (1, "A", "a@x", None, " ", None, None),
        (2, "B", "a@x", None, None, "premium", "active"),
        (3, "C", "c@x", None, "2030-01-02", "gold", "active"),
        (4, "D", "arjun.sharma@email.com", None, None, None, None),
        (5, "E", "e@x", "1", "2030-01-02", "student", "suspended"),
        (6, "F", "f@x", "1", "someday", "student", "active"),
    ]
    result = upkeep.add_members(lib, requests(spark, MEMBER_FORM, rows), TODAY)
    assert reasons(result) == [
        None, jobs.DUPLICATE_EMAIL, jobs.BAD_DOMAIN, jobs.DUPLICATE_EMAIL, None, jobs.BAD_DATE
    ]
    new = result.state.members.where("member_id > 8").orderBy("member_id").collect()
    assert [(r.member_id, r.expiry_date, r.membership_type, r.status, r.join_date) for r in new] == [
        (9, TODAY + timedelta(days=365), "standard", "active", TODAY),
        (10, date(2030, 1, 2), "student", "suspended", TODAY),
    ]


def test_update_books(spark):
    lib = library(spark, books=[{"total_copies": 5, "available_copies": 2}, {"total_copies": 1}])
    rows = [
        (1, 1, "T1", "A", "G", "1900", 4),
        (2, 1, "T2", "A", "G", "1901", 2),
        (3, 1, "T3", "A", "G", "", None),
        (4, 9, "T", "A", "G", "", 1),
        (5, 2, None, "A", "G", "", 1),
        (6, 1, "T6", "A", "G", "x", 8),
    ]
    result = upkeep.update_books(lib, requests(spark, BOOK_CHANGE, rows))
    assert reasons(result) == [
        None, jobs.TOO_FEW_COPIES, None, jobs.BOOK_NOT_FOUND, jobs.MISSING_FIELD, jobs.BAD_NUMBER
    ]
    first, second = result.state.books.orderBy("book_id").collect()
    assert (first.title, first.year_published, first.total_copies, first.available_copies) == ("T3", None, 4, 1)
    assert (second.title, second.total_copies) == ("t", 1)


def test_update_members(spark, lib):
    columns = MEMBER_FORM.replace("seq long", "seq long, member_id long")
    rows = [
        (1, 1, "Arjun", "a@x", None, "", "premium", "suspended"),
        (2, 1, "Arjun S", "a@x", None, "2030-01-02", "student", "active"),
        (3, 77, "No", "n@x", None, "", "student", "active"),
        (4, 2, "P", "p@x", None, "", "student", "gone"),
    ]
    result = upkeep.update_members(lib, requests(spark, columns, rows), TODAY)
    assert reasons(result) == [None, None, None, jobs.BAD_DOMAIN]
    row = result.state.members.where("member_id = 1").collect()[0]
    assert (row.full_name, row.phone, row.expiry_date, row.status) == ("Arjun S", None, date(2030, 1, 2), "active")
    assert result.state.members.count() == 8


def orphans(state):
    return sum(r.orphan_rows for r in quality.check_references(state).collect())


def test_delete_books_leaves_no_orphans(spark, lib):
    state = upkeep.delete_books(lib, requests(spark, "book_id long", [(3,), (3,), (8,)]))
    assert [df.count() for _, df in state.items()] == [13, 8, 17, 2, 3]
    assert orphans(state) == 0


@pytest.mark.parametrize("guard, left", [(False, 6), (True, 7)])
def test_delete_members(spark, lib, guard, left):
    closed = lib.with_tables(loans=lib.loans.where("member_id <> 3 OR return_date IS NOT NULL"))
    result = upkeep.delete_members(closed, requests(spark, "member_id long", [(3,), (8,)]), guard)
    assert result.state.members.count() == left
    assert orphans(result.state) == 0
    assert {r.member_id: r.accepted for r in result.outcomes.collect()} == {3: True, 8: not guard}


def test_audits_pass_on_the_baseline(lib):
    assert sum(r.violations for r in quality.check_domains(lib).collect()) == 0
    assert sum(r.duplicate_values for r in quality.check_unique(lib).collect()) == 0
    assert orphans(lib) == 0


def test_audits_find_what_is_broken(spark):
    broken = library(
        spark,
        books=[{"isbn": "d", "year_published": 0}, {"isbn": "d"}],
        members=[{"membership_type": "gold", "email": "1"}, {"status": "asleep", "email": "2"}],
        loans=[{"book_id": 9}, {"member_id": 9}],
        fines=[{"amount": Decimal("0.00"), "loan_id": 7}],
        reservations=[{"queue_position": 1}, {"queue_position": 1}, {"queue_position": 1, "book_id": 2}],
    )
    found = {(r.table_name, r.rule) for r in quality.check_domains(broken).where("violations > 0").collect()}
    assert found == {
        ("books", "year_published > 0"), ("members", "membership_type domain"), ("members", "status domain"),
        ("fines", "amount > 0"),
    }
    duplicates = quality.check_unique(broken).where("duplicate_values > 0").collect()
    assert {(r.key_columns, r.surplus_rows) for r in duplicates} == {("isbn", 1), ("book_id, queue_position", 1)}
    missing = quality.check_references(broken).where("orphan_rows > 0").collect()
    assert {(r.table_name, r.column_name) for r in missing} == {
        ("loans", "book_id"), ("loans", "member_id"), ("fines", "loan_id")
    }


def test_inventory_drift_of_the_baseline(lib):
    """The stored copies of the baseline ignore its open loans; the audit shows each of them."""
    drift = quality.check_inventory(lib.books, lib.loans).collect()
    assert sum(r.drift for r in drift) == 11
    assert {r.book_id for r in drift} == {1, 2, 4, 5, 6, 9, 11, 12, 14, 15}
