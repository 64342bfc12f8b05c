"""Table schemas and the fixed business values of the lending domain."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Loan period in days by membership tier, fine per late day, and the limits of the circulation rules.
LOAN_DAYS = {"standard": 14, "student": 21, "premium": 30}
FINE_PER_DAY = Decimal("0.50")
MAX_RENEWALS = 2
MEMBERSHIP_DAYS = 365
UNDO_DEPTH = 15

# Allowed membership tiers and member states.
MEMBERSHIP_TYPES = ["standard", "premium", "student"]
MEMBER_STATES = ["active", "suspended", "expired"]

# Longest texts of the columns that have a limit.
TEXT_LENGTHS = {
    "books": {"isbn": 13, "title": 255, "author": 255, "genre": 50},
    "members": {"full_name": 100, "email": 150, "phone": 20},
}

MONEY = T.DecimalType(8, 2)
MONEY_SUM = T.DecimalType(18, 2)


def _struct(*columns: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, nullable) for name, kind, nullable in columns])


BOOKS = _struct(
    ("book_id", T.LongType(), False),
    ("isbn", T.StringType(), False),
    ("title", T.StringType(), False),
    ("author", T.StringType(), False),
    ("genre", T.StringType(), False),
    ("year_published", T.ShortType(), True),
    ("total_copies", T.IntegerType(), False),
    ("available_copies", T.IntegerType(), False),
    ("added_at", T.TimestampNTZType(), False),
)

MEMBERS = _struct(
    ("member_id", T.LongType(), False),
    ("full_name", T.StringType(), False),
    ("email", T.StringType(), False),
    ("phone", T.StringType(), True),
    ("join_date", T.DateType(), False),
    ("expiry_date", T.DateType(), False),
    ("membership_type", T.StringType(), False),
    ("status", T.StringType(), False),
)

LOANS = _struct(
    ("loan_id", T.LongType(), False),
    ("book_id", T.LongType(), False),
    ("member_id", T.LongType(), False),
    ("loan_date", T.DateType(), False),
    ("due_date", T.DateType(), False),
    ("return_date", T.DateType(), True),
    ("renewed_count", T.ShortType(), False),
)

FINES = _struct(
    ("fine_id", T.LongType(), False),
    ("loan_id", T.LongType(), False),
    ("member_id", T.LongType(), False),
    ("amount", MONEY, False),
    ("issued_date", T.DateType(), False),
    ("paid", T.BooleanType(), False),
    ("paid_date", T.DateType(), True),
)

RESERVATIONS = _struct(
    ("reservation_id", T.LongType(), False),
    ("book_id", T.LongType(), False),
    ("member_id", T.LongType(), False),
    ("reserved_date", T.DateType(), False),
    ("queue_position", T.IntegerType(), False),
    ("notified", T.BooleanType(), False),
)

SCHEMAS = {"books": BOOKS, "members": MEMBERS, "loans": LOANS, "fines": FINES, "reservations": RESERVATIONS}


class TableSet:
    """The five tables of one library state. Jobs return a changed copy and never touch their input.

    A table may be given as a function without arguments, which is called on first use.
    """

    def __init__(self, **tables: DataFrame | Callable[[], DataFrame]):
        if set(tables) != set(SCHEMAS):
            raise ValueError(f"expected the tables {sorted(SCHEMAS)}, got {sorted(tables)}")
        self._tables = tables

    def _table(self, name: str) -> DataFrame:
        table = self._tables[name]
        if not isinstance(table, DataFrame):
            table = self._tables[name] = table()
        return table

    @property
    def books(self) -> DataFrame:
        return self._table("books")

    @property
    def members(self) -> DataFrame:
        return self._table("members")

    @property
    def loans(self) -> DataFrame:
        return self._table("loans")

    @property
    def fines(self) -> DataFrame:
        return self._table("fines")

    @property
    def reservations(self) -> DataFrame:
        return self._table("reservations")

    def items(self) -> list[tuple[str, DataFrame]]:
        return [(name, self._table(name)) for name in SCHEMAS]

    def with_tables(self, **changed: DataFrame | Callable[[], DataFrame]) -> TableSet:
        return TableSet(**{**self._tables, **changed})


def conform(df: DataFrame, table: str) -> DataFrame:
    """Project a frame to the column order and types of a library table."""
    return df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in SCHEMAS[table]])


def collated(lib: TableSet, collation: str = "UTF8_LCASE") -> TableSet:
    """The same tables with collated text, so that `=`, GROUP BY, joins and LIKE on it ignore case."""

    def collate(df: DataFrame) -> DataFrame:
        texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
        return df.withColumns({name: F.collate(name, collation) for name in texts}) if texts else df

    return TableSet(**{name: collate(df) for name, df in lib.items()})
