"""Report values on the baseline library, worked out by hand (see FIXTURES.md)."""

from datetime import date
from decimal import Decimal as D

from lendframe.operators import catalogue, fines, loans, overview, people, waitlist
from lendframe.schema import collated
from tests.builders import library, table


def tuples(df):
    return [tuple(row) for row in df.collect()]


def test_table_counts(lib):
    assert dict(tuples(overview.table_counts(lib))) == {
        "books": 15, "members": 8, "loans": 20, "fines": 5, "reservations": 4
    }


def test_list_books_is_sorted(lib):
    titles = [r.title for r in catalogue.list_books(lib.books).collect()]
    assert titles == sorted(titles) and titles[0] == "1984" and "The Hitchhiker's Guide" in titles


def test_active_members(lib):
    assert [r.member_id for r in people.active_members(lib.members, date(2025, 1, 15)).collect()] == [1, 2, 4, 5, 7, 8]
    assert [r.member_id for r in people.active_members(lib.members, date(2025, 1, 16)).collect()] == [2, 4, 5, 7, 8]


def test_genre_or_title_keeps_duplicates(lib):
    rows = tuples(catalogue.books_by_genre_or_title(lib.books, "Science Fiction", "%foundation%"))
    assert len(rows) == 5 and [r[0] for r in rows].count("Foundation") == 2


def test_genre_counts(lib):
    assert set(tuples(catalogue.genre_counts(lib.books))) == {
        ("Fiction", 5, 11, 1956), ("Science Fiction", 4, 13, 1961), ("Classic", 2, 5, 1840),
        ("Non-Fiction", 2, 7, 2011), ("Science", 2, 5, 1982),
    }


def test_members_joined_in_year(lib):
    names = [r.full_name for r in people.members_joined_in_year(lib.members, date(2024, 12, 31)).collect()]
    assert names == ["Lakshmi Iyer", "Aditya Kumar", "Divya Menon", "Kiran Rao", "Sneha Patel"]


def test_overdue(lib, today):
    rows = loans.overdue_loans(lib.loans, lib.members, lib.books, today).collect()
    assert (rows[0].loan_id, rows[0].days_overdue) == (11, 36)
    assert [r.loan_id for r in rows] == [11, 19, 16, 4, 6, 9, 12, 17, 14, 20, 15]
    first = loans.top_overdue(lib.loans, lib.members, lib.books, today).collect()
    assert [r.loan_id for r in first] == [11, 19, 16, 4, 6] and first[0].fine_so_far == D("18.00")


def test_unpaid(lib):
    rows = tuples(people.members_with_unpaid_fines(lib.members, lib.fines).select("full_name", "open_fines", "total_owed"))
    assert rows == [("Divya Menon", 1, D("5.50")), ("Lakshmi Iyer", 1, D("3.50"))]


def test_top_borrowed(lib):
    rows = tuples(catalogue.top_borrowed(lib.books, lib.loans))
    assert [r[0] for r in rows] == [
        "To Kill a Mockingbird", "The Great Gatsby", "1984", "The Hitchhiker's Guide", "Dune"
    ] and {r[2] for r in rows} == {2}


def test_empty_by_design(lib, today):
    assert catalogue.never_borrowed(lib.books, lib.loans).isEmpty()
    assert people.members_overdue_more_than(lib.loans, lib.members, today).isEmpty()
    assert people.members_with_all_genres(lib.members, lib.loans, lib.books).isEmpty()
    assert overview.search(lib.books, lib.members, "%tolkien%").isEmpty()
    assert catalogue.duplicate_isbns(lib.books).isEmpty()


def test_return_time(lib):
    assert set(tuples(loans.return_time_by_genre(lib.loans, lib.books))) == {
        ("Fiction", 4, 11.8, 10, 13), ("Science Fiction", 3, 19.3, 12, 25), ("Classic", 1, 24.0, 24, 24),
        ("Non-Fiction", 1, 21.0, 21, 21),
    }


def test_monthly_trend(lib):
    rows = tuples(loans.monthly_loan_trend(lib.loans, date(2025, 2, 10)))
    assert rows == [("2024-02-01", 5, 4), ("2024-03-01", 8, 6)]


def test_fine_revenue(lib):
    assert tuples(fines.fine_revenue_by_month(lib.fines)) == [
        ("2024-03-01", 1, D("4.50"), D("4.50"), D("0.00")),
        ("2024-02-01", 3, D("9.00"), D("5.50"), D("3.50")),
        ("2024-01-01", 1, D("5.50"), D("0.00"), D("5.50")),
    ]
    assert tuples(fines.fine_totals(lib.fines)) == [(D("10.00"), D("9.00"))]


def test_shared_borrowers(lib):
    pairs = {(a, b) for a, b, _ in tuples(people.borrower_pairs(lib.loans, lib.members, lib.books))}
    assert pairs == {
        ("Arjun Sharma", "Rohit Shetty"), ("Arjun Sharma", "Kiran Rao"), ("Priya Nair", "Divya Menon"),
        ("Rohit Shetty", "Lakshmi Iyer"), ("Priya Nair", "Sneha Patel"),
    }


def test_running_fines(lib):
    assert [(r.full_name.split()[0], r.running_total) for r in fines.running_fines(lib.fines, lib.members).collect()] == [
        ("Divya", D("5.50")), ("Divya", D("7.50")), ("Kiran", D("4.50")), ("Lakshmi", D("3.50")), ("Priya", D("3.50"))
    ]


def test_rank_members(lib):
    rows = tuples(people.rank_members(lib.members, lib.loans))
    assert [r[1:] for r in rows] == [
        (3, 1, 1, 1), (3, 1, 1, 2), (3, 1, 1, 3), (3, 1, 1, 4), (2, 5, 2, 5), (2, 5, 2, 6), (2, 5, 2, 7), (2, 5, 2, 8)
    ]


def test_moving_average(lib):
    assert tuples(loans.moving_avg_loans(lib.loans)) == [
        ("2024-01-01", 6, 6.0), ("2024-02-01", 6, 6.0), ("2024-03-01", 8, 6.7)
    ]


def test_first_and_last_book(lib):
    assert ("Arjun Sharma", "To Kill a Mockingbird", "A Brief History of Time") in tuples(
        people.first_last_book(lib.loans, lib.members, lib.books)
    )


def test_borrow_gaps(lib):
    rows = [r for r in people.borrow_gaps(lib.loans, lib.members, lib.books).collect() if r.full_name == "Arjun Sharma"]
    assert [r.days_since_prev_loan for r in rows] == [None, 26, 49]


def test_reservation_chain(lib):
    rows = waitlist.reservation_chain(lib.reservations, lib.members).collect()
    assert [(r.book_id, r.depth) for r in rows] == [(3, 1), (6, 1), (9, 1), (11, 1)]


def test_above_average(lib):
    rows = catalogue.above_average_books(lib.books, lib.loans).collect()
    assert [r.borrow_count for r in rows] == [2] * 5


def test_rolling_revenue(lib):
    assert tuples(fines.rolling_fine_revenue(lib.fines)) == [
        (date(2024, 2, 6), D("3.50"), D("3.50")), (date(2024, 2, 9), D("2.00"), D("5.50")),
        (date(2024, 3, 11), D("4.50"), D("10.00")),
    ]


def test_consecutive_months(lib):
    assert tuples(people.consecutive_month_members(lib.loans)) == [(1, 2), (8, 2)]


def test_searches(lib, today):
    books = catalogue.list_books(lib.books)
    assert overview.multi_column_search(books, ["title", "author", "genre"], "LEE").count() == 2
    assert overview.multi_column_search(lib.members, ["full_name", "phone"], "").count() == 8
    listed = fines.fine_list(lib.fines, lib.members, lib.loans, lib.books)
    assert fines.filter_fines(listed, "paid").count() == 3
    assert fines.filter_fines(listed, "unpaid", "1984").count() == 1
    assert overview.dashboard_stats(lib).collect()[0].asDict() == {
        "total_books": 15, "total_members": 8, "active_loans": 11, "unpaid_fines": 2
    }


def test_chain_stops_at_gap_and_needs_a_head(spark):
    small = library(
        spark,
        members=[{}],
        reservations=[{"book_id": 1, "queue_position": p} for p in (1, 2, 4)] + [{"book_id": 2, "queue_position": 2}],
    )
    rows = waitlist.reservation_chain(small.reservations, small.members).collect()
    assert [(r.book_id, r.queue_position, r.depth) for r in rows] == [(1, 1, 1), (1, 2, 2)]


def test_history_repeats_a_loan_with_two_fines(spark, today):
    small = library(spark, books=[{}], members=[{}], loans=[{}], fines=[{"amount": D("1.00")}, {"amount": D("2.00")}])
    rows = loans.member_history(small.loans, small.books, small.fines, today).collect()
    assert [r.fine_amount for r in sorted(rows, key=lambda r: r.fine_amount)] == [D("1.00"), D("2.00")]
    nobody = small.members.where("member_id = 9")
    assert loans.member_history(small.loans, small.books, small.fines, today, nobody).isEmpty()


def test_duplicate_isbns_have_a_row_per_book(spark):
    books = table(spark, "books", [{"isbn": "d", "title": f"t{i}"} for i in range(3)] + [{"isbn": "s"}])
    assert tuples(catalogue.duplicate_isbns(books)) == [("d", 3, 1, 1, "t0"), ("d", 3, 2, 2, "t1"), ("d", 3, 3, 3, "t2")]


def test_first_and_last_book_of_very_large_ids(spark):
    first, second = date(2024, 1, 1), date(2024, 1, 3)
    small = library(
        spark, books=[{"title": "early"}, {"title": "late"}], members=[{}],
        loans=[
            {"loan_id": 5 * 2**46, "book_id": 1, "loan_date": first}, {"loan_id": 7, "book_id": 2, "loan_date": second},
            {"loan_id": 2**62, "book_id": 1, "loan_date": second},
        ],
    )
    assert tuples(people.first_last_book(small.loans, small.members, small.books)) == [("n", "early", "late")]


def test_shared_borrowers_are_counted_per_borrower(lib):
    rows = people.shared_borrowers(lib.loans, lib.members, lib.books).collect()
    pairs = people.borrower_pairs(lib.loans, lib.members, lib.books).count()
    assert sum(r.later_co_borrowers for r in rows) == pairs and sum(r.co_borrowers for r in rows) == 2 * pairs


def test_all_genres(spark):
    small = library(
        spark,
        books=[{"genre": "a"}, {"genre": "b"}],
        members=[{}, {}],
        loans=[{"book_id": 1, "member_id": 1}, {"book_id": 2, "member_id": 1}, {"book_id": 2, "member_id": 2}],
    )
    assert [r.member_id for r in people.members_with_all_genres(small.members, small.loans, small.books).collect()] == [1]
    no_books = small.with_tables(books=small.books.limit(0))
    assert people.members_with_all_genres(no_books.members, no_books.loans, no_books.books).count() == 2


def test_percentile_edges(spark):
    one = library(spark, members=[{}], fines=[{}])
    assert tuples(fines.fine_percentiles(one.fines, one.members)) == [("n", D("1.00"), 1, 0.0)]
    three = library(
        spark, members=[{"full_name": n} for n in "abc"],
        fines=[{"member_id": i, "amount": D(i)} for i in (1, 2, 3)],
    )
    assert tuples(fines.fine_percentiles(three.fines, three.members)) == [
        ("c", D("3.00"), 1, 100.0), ("b", D("2.00"), 2, 50.0), ("a", D("1.00"), 3, 0.0)
    ]


def test_same_names_collapse_in_first_last_book(spark):
    small = library(
        spark, books=[{}], members=[{}, {}], loans=[{"member_id": 1}, {"member_id": 2}]
    )
    assert people.first_last_book(small.loans, small.members, small.books).count() == 1


def test_same_names_pair_once(spark):
    """Two namesakes share a book: one pair with twice the name, however many of them there are."""
    small = library(
        spark, books=[{}], members=[{"full_name": n} for n in ("x", "x", "y", "x")],
        loans=[{"member_id": i} for i in (1, 2, 3, 4, 4)],
    )
    assert set(tuples(people.borrower_pairs(small.loans, small.members, small.books, cell_rows=1))) == {
        ("x", "x", "t"), ("x", "y", "t"), ("y", "x", "t")
    }


def test_leap_day_month_arithmetic(spark):
    small = library(spark, loans=[{"loan_date": date(2023, 2, 28)}, {"loan_date": date(2023, 2, 27)}])
    assert tuples(loans.monthly_loan_trend(small.loans, date(2024, 2, 29))) == [("2023-02-01", 1, 1)]


def test_collated_text_ignores_case(lib):
    assert catalogue.books_by_genre_or_title(lib.books, "CLASSIC", "-").count() == 0
    relaxed = collated(lib)
    assert catalogue.books_by_genre_or_title(relaxed.books, "CLASSIC", "-").count() == 2
    assert catalogue.genre_counts(relaxed.books).count() == 5
    assert overview.search(relaxed.books, relaxed.members, "%AUSTEN%").count() == 1
    assert fines.running_fines(relaxed.fines, relaxed.members).count() == 5
