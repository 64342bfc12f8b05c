"""Small library states for tests, with only the columns a test cares about spelled out."""

from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession

from lendframe.schema import SCHEMAS, TableSet

DAY = date(2024, 1, 1)

DEFAULTS = {
    "books": {"isbn": "x", "title": "t", "author": "a", "genre": "g", "year_published": 2000, "total_copies": 1,
              "available_copies": 1, "added_at": datetime(2024, 1, 1)},
    "members": {"full_name": "n", "email": "e", "phone": None, "join_date": DAY, "expiry_date": DAY,
                "membership_type": "standard", "status": "active"},
    "loans": {"book_id": 1, "member_id": 1, "loan_date": DAY, "due_date": DAY, "return_date": None, "renewed_count": 0},
    "fines": {"loan_id": 1, "member_id": 1, "amount": Decimal("1.00"), "issued_date": DAY, "paid": False,
              "paid_date": None},
    "reservations": {"book_id": 1, "member_id": 1, "reserved_date": DAY, "queue_position": 1, "notified": False},
}


def table(spark: SparkSession, name: str, rows: list[dict]) -> DataFrame:
    """Rows of a library table; the key counts from 1 where it is not given."""
    schema = SCHEMAS[name]
    key = schema[0].name
    full = [{key: i, **DEFAULTS[name], **row} for i, row in enumerate(rows, 1)]
    return spark.createDataFrame([tuple(r[f.name] for f in schema) for r in full], schema)


def library(spark: SparkSession, **rows: list[dict]) -> TableSet:
    return TableSet(**{name: table(spark, name, rows.get(name, [])) for name in SCHEMAS})


def requests(spark: SparkSession, columns: str, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, columns)


def dicts(df: DataFrame) -> list[dict]:
    return [row.asDict() for row in df.collect()]
