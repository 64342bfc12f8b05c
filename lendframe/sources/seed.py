"""The baseline library: fifteen books, eight members and their history. Also the state `reset` goes back to."""

from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import SparkSession

from lendframe.schema import SCHEMAS, TableSet

# Isbn, title, author, genre, year, copies.
BOOK_ROWS = """
9780061096006|To Kill a Mockingbird|Harper Lee|Fiction|1960|3
9780743273565|The Great Gatsby|F. Scott Fitzgerald|Fiction|1925|2
9780451524935|1984|George Orwell|Science Fiction|1949|4
9780061120084|To Kill a Mockingbird 2|Harper Lee|Fiction|1960|2
9780345391803|The Hitchhiker's Guide|Douglas Adams|Science Fiction|1979|3
9780743477123|Dune|Frank Herbert|Science Fiction|1965|3
9780385490818|The Handmaid's Tale|Margaret Atwood|Fiction|1985|2
9780679783268|Crime and Punishment|Fyodor Dostoevsky|Classic|1866|2
9780141439518|Pride and Prejudice|Jane Austen|Classic|1813|3
9780316769174|The Catcher in the Rye|J.D. Salinger|Fiction|1951|2
9780553293357|Foundation|Isaac Asimov|Science Fiction|1951|3
9780062316097|Sapiens|Yuval Noah Harari|Non-Fiction|2011|4
9781501156700|Thinking Fast and Slow|Daniel Kahneman|Non-Fiction|2011|3
9780385333481|The Selfish Gene|Richard Dawkins|Science|1976|2
9780679601685|A Brief History of Time|Stephen Hawking|Science|1988|3
"""

# Name, email, phone, joined, expires, tier, state.
MEMBER_ROWS = """
Arjun Sharma|arjun.sharma@email.com|9876543210|2023-01-15|2025-01-15|standard|active
Priya Nair|priya.nair@email.com|9845012345|2023-03-20|2025-03-20|premium|active
Rohit Shetty|rohit.shetty@email.com|9731245678|2023-06-10|2024-06-10|student|expired
Sneha Patel|sneha.patel@email.com|9632587410|2024-01-05|2026-01-05|premium|active
Kiran Rao|kiran.rao@email.com|9512345678|2024-02-14|2026-02-14|standard|active
Divya Menon|divya.menon@email.com|9423156789|2024-04-01|2025-04-01|student|suspended
Aditya Kumar|aditya.kumar@email.com|9314567890|2024-06-20|2026-06-20|standard|active
Lakshmi Iyer|lakshmi.iyer@email.com|9205678901|2024-08-11|2026-08-11|premium|active
"""

# Book, member, loaned, due, returned, renewals.
LOAN_ROWS = """
1|1|2024-01-10|2024-01-24|2024-01-20|0
2|1|2024-02-05|2024-02-19|2024-02-18|0
3|2|2024-01-15|2024-01-29|2024-02-05|1
4|2|2024-03-01|2024-03-15||0
5|3|2024-02-10|2024-02-24|2024-02-22|0
6|4|2024-03-05|2024-03-19||0
7|4|2024-01-20|2024-02-03|2024-02-01|0
8|5|2024-02-15|2024-03-01|2024-03-10|0
9|5|2024-03-10|2024-03-24||1
10|6|2024-01-25|2024-02-08|2024-02-06|0
11|7|2024-02-20|2024-03-05||0
12|7|2024-03-15|2024-03-29||0
13|8|2024-01-30|2024-02-13|2024-02-20|0
14|8|2024-03-20|2024-04-03||0
15|1|2024-03-25|2024-04-08||0
1|3|2024-02-28|2024-03-13||0
2|5|2024-03-18|2024-04-01||0
3|6|2024-01-05|2024-01-19|2024-01-30|0
5|8|2024-02-25|2024-03-10||0
6|2|2024-03-22|2024-04-05||0
"""

# Loan, member, amount, issued, paid on.
FINE_ROWS = """
3|2|3.50|2024-02-06|2024-02-10
8|5|4.50|2024-03-11|2024-03-15
13|8|3.50|2024-02-21|
18|6|5.50|2024-01-31|
10|6|2.00|2024-02-09|2024-02-12
"""

# Book, member, reserved, place in the queue, notified.
RESERVATION_ROWS = """
3|4|2024-03-20|1|0
6|1|2024-03-23|1|0
9|7|2024-03-25|1|1
11|3|2024-03-26|1|0
"""


def _rows(text: str) -> list[list[str]]:
    return [line.split("|") for line in text.strip().splitlines()]


def _day(text: str) -> date | None:
    return date.fromisoformat(text) if text else None


def seed(spark: SparkSession) -> TableSet:
    """The baseline tables with ids from 1 in the order above."""
    added = datetime(2024, 1, 1)
    rows = {
        "books": [
            (i, isbn, title, author, genre, int(year), int(n), int(n), added)
            for i, (isbn, title, author, genre, year, n) in enumerate(_rows(BOOK_ROWS), 1)
        ],
        "members": [
            (i, name, email, phone, _day(joined), _day(expires), tier, state)
            for i, (name, email, phone, joined, expires, tier, state) in enumerate(_rows(MEMBER_ROWS), 1)
        ],
        "loans": [
            (i, int(book), int(member), _day(start), _day(due), _day(back), int(renewed))
            for i, (book, member, start, due, back, renewed) in enumerate(_rows(LOAN_ROWS), 1)
        ],
        "fines": [
            (i, int(loan), int(member), Decimal(amount), _day(issued), bool(settled), _day(settled))
            for i, (loan, member, amount, issued, settled) in enumerate(_rows(FINE_ROWS), 1)
        ],
        "reservations": [
            (i, int(book), int(member), _day(day), int(place), told == "1")
            for i, (book, member, day, place, told) in enumerate(_rows(RESERVATION_ROWS), 1)
        ],
    }
    return TableSet(**{name: spark.createDataFrame(rows[name], SCHEMAS[name]) for name in SCHEMAS})
