"""Run a query and its SQL and compare columns, types and rows without regard to order."""

from __future__ import annotations

import math
from collections import Counter
from datetime import datetime
from decimal import Decimal

import duckdb
from pyspark.sql import SparkSession
from pyspark.sql import types as T

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"

FAMILIES = {
    T.LongType: {"BIGINT"},
    T.IntegerType: {"INTEGER"},
    T.ShortType: {"SMALLINT"},
    T.StringType: {"VARCHAR"},
    T.DateType: {"DATE"},
    T.BooleanType: {"BOOLEAN"},
    T.DoubleType: {"DOUBLE"},
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in (TABLES + " conversations").split():
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    if isinstance(value, Decimal):
        return value.normalize()
    if isinstance(value, datetime):
        return value.replace(tzinfo=None)
    return value


def differences(spark: SparkSession, sf_dir: str, query, sql: str, con=None) -> list[str]:
    """What differs, empty if nothing does."""
    df = query(spark, sf_dir)
    con = con or connect(sf_dir)
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    kinds = {c[0]: str(c[1]) for c in result.description}
    found = []
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} vs {sorted(names)}"]
    for field in df.schema:
        kind = kinds[field.name]
        if isinstance(field.dataType, T.DecimalType):
            expected = {f"DECIMAL({field.dataType.precision},{field.dataType.scale})"}
        else:
            expected = FAMILIES[type(field.dataType)]
        if kind not in expected:
            found.append(f"type of {field.name}: {field.dataType.simpleString()} vs {kind}")
    order = sorted(names)
    ours = Counter(tuple(_plain(row[c]) for c in order) for row in df.collect())
    theirs = Counter(
        tuple(_plain(row[names.index(c)]) for c in order) for row in result.fetchall()
    )
    if ours != theirs:
        more, less = ours - theirs, theirs - ours
        found.append(
            f"{sum(ours.values())} vs {sum(theirs.values())} rows; only here {list(more)[:2]}, only there {list(less)[:2]}"
        )
    if not ours:
        found.append("no rows")
    return found
