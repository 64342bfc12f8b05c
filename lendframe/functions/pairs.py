"""Pairs of rows that share a key, with the work of a large group spread over many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pairs_within(
    left: DataFrame, right: DataFrame, key: str, left_salt: str, right_salt: str, cell_rows: int = 20_000
) -> DataFrame:
    """Inner equi-join of two sides on `key` in which a big group is laid out as a grid of cells.

    A group of n rows gets g = ceil(n / cell_rows) strips per side. A left row falls into strip i and goes to the cells
    (i, 0..g-1), a right row falls into strip j and goes to (0..g-1, j): every pair meets in exactly one cell, and a
    cell has about cell_rows rows a side. Groups of ordinary size have one cell and are not copied.
    """
    sizes = left.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / F.lit(cell_rows)).cast("int").alias("_g"))
    every = F.explode(F.sequence(F.lit(0), F.col("_g") - 1))

    def cells(side: DataFrame, salt: str, own: str, other: str) -> DataFrame:
        strip = F.pmod(F.xxhash64(salt), F.col("_g")).cast("int")
        strips = side.join(sizes, key).withColumn(own, strip)
        # By strip first, so that the copies of a big group are made by many tasks and not where its rows met its size.
        return strips.repartition(key, own).select(*side.columns, own, every.alias(other))

    a = cells(left, left_salt, "_i", "_j")
    b = cells(right, right_salt, "_j", "_i")
    return a.join(b, [key, "_i", "_j"]).drop("_i", "_j")
