"""Ordered per-group calculations that stay parallel when one group holds a large share of the rows.

A plain window sends a whole group to one task. Groups of up to `HotRule.rows` rows are left to it. The rows of a *hot*
group, one above that mark, are dealt into chunks of about equal size by range partitioning in the order of the window,
whatever the values of its columns are; every chunk is worked on separately and then shifted by what the earlier chunks add
up to. The chunks are written to the shared folder once, so that all parts of the calculation see the same ones.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lendframe.sources.workspace import work_dir, written


@dataclass(frozen=True)
class HotRule:
    """A group is hot when it has more than `rows` rows, what one task may hold. There are at most total / rows of them."""

    rows: int = 1_000_000


DEFAULT_RULE = HotRule()
BUCKETS = 1 << 14  # hashes of keys that rows are counted by before keys are


def hot_keys(df: DataFrame, keys: list[str], rule: HotRule = DEFAULT_RULE) -> DataFrame:
    """Key values of hot groups. A group is hot only if the bucket of its hash has as many rows, so that keys are counted one
    by one in crowded buckets alone; where there is none, hardly anything is moved."""
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).alias("_bucket")
    full = df.groupBy(bucket).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > rule.rows).select("_bucket")
    near = df.select(*keys, bucket).join(F.broadcast(full), "_bucket", "left_semi")  # at most BUCKETS rows
    return near.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > rule.rows).select(*keys)


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Equal keys, null being equal to null."""
    return reduce(and_, (left[k].eqNullSafe(right[f"_k_{k}"]) for k in keys), F.lit(True))


def _renamed(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.withColumnsRenamed({k: f"_k_{k}" for k in keys})


def grouped_window(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    *,
    row_number: str | None = None,
    running_sum: dict[str, str] | None = None,
    lag: dict[str, str] | None = None,
    rule: HotRule = DEFAULT_RULE,
) -> DataFrame:
    """Add row_number, running sums and lags over `PARTITION BY keys ORDER BY order`.

    `order` must be unique inside a group. With no keys the whole input is one group. `running_sum` and `lag` map new
    column names to input columns. Groups are counted when this is called; only where one is hot, rows are dealt into
    chunks.
    """
    running_sum, lag = running_sum or {}, lag or {}
    outs = [*([row_number] if row_number else []), *running_sum, *lag]

    def over(rows: DataFrame, parts: list[str]) -> DataFrame:
        inside = W.partitionBy(*parts).orderBy(*order)
        upto = inside.rowsBetween(W.unboundedPreceding, W.currentRow)
        sums = {out: F.sum(src).over(upto) for out, src in running_sum.items()}
        return rows.select(
            "*",
            *([F.row_number().over(inside).cast("long").alias(row_number)] if row_number else []),
            *[F.coalesce(total, F.lit(0)).alias(out) for out, total in sums.items()],
            *[F.lag(src).over(inside).alias(out) for out, src in lag.items()],
        )

    kinds = {f.name: f.dataType for f in df.select(*[F.sum(s).alias(o) for o, s in running_sum.items()]).schema}
    casts = {out: F.col(out).cast(kind) for out, kind in kinds.items()}
    if keys:
        hot = hot_keys(df, keys, rule)
        if hot.isEmpty():
            return over(df, keys).withColumns(casts).select(*df.columns, *outs)
        hot = _renamed(hot, keys)
        cold, rows = (df.join(hot, _same(df, hot, keys), how) for how in ("left_anti", "left_semi"))
    elif df.limit(rule.rows + 1).count() <= rule.rows:
        return over(df, []).withColumns(casts).select(*df.columns, *outs)
    else:
        cold, rows = None, df

    dealt = rows.repartitionByRange(*keys, *order).withColumn("_chunk", F.spark_partition_id())
    dealt = written(dealt, work_dir(df.sparkSession))
    local = over(dealt, [*keys, "_chunk"]).withColumn(
        "_first", F.row_number().over(W.partitionBy(*keys, "_chunk").orderBy(*order)) == 1
    )
    # One row per chunk of a hot group; the window below runs over chunks, not over rows.
    totals = dealt.groupBy(*keys, "_chunk").agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.sum(src).alias(f"_s_{out}") for out, src in running_sum.items()],
        *[F.max_by(src, F.struct(*order)).alias(f"_l_{out}") for out, src in lag.items()],
    )
    chunks = W.partitionBy(*keys).orderBy("_chunk")
    before = chunks.rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *keys,
        F.col("_chunk").alias("_k__chunk"),
        F.sum("_n").over(before).alias("_before_n"),
        *[F.sum(f"_s_{out}").over(before).alias(f"_before_{out}") for out in running_sum],
        *[F.lag(f"_l_{out}").over(chunks).alias(f"_last_{out}") for out in lag],
    )
    offsets = _renamed(offsets, keys)
    joined = local.join(offsets, _same(local, offsets, [*keys, "_chunk"]))
    shifted = {out: F.col(out) + F.coalesce(F.col(f"_before_{out}"), F.lit(0)) for out in running_sum}
    if row_number:
        shifted[row_number] = F.col(row_number) + F.coalesce("_before_n", F.lit(0))
    shifted |= {out: F.when(F.col("_first"), F.col(f"_last_{out}")).otherwise(F.col(out)) for out in lag}
    done = joined.withColumns(shifted).withColumns(casts).select(*df.columns, *outs)
    return done if cold is None else done.unionByName(over(cold, keys).withColumns(casts).select(*df.columns, *outs))


def latest_per_key(df: DataFrame, key: str, order: str, values: dict[str, tuple[str, Column]]) -> DataFrame:
    """Per key, the value of each column at the highest `order` among the rows where its condition holds.

    `values` maps new names to (input column, condition); `order` is unique. First only the highest `order` of each key is
    found, combined on the map side, then the one row it belongs to is fetched.
    """
    numbered = df.groupBy(key).agg(
        *[F.max(F.when(cond, F.col(order))).alias(f"_at_{out}") for out, (_, cond) in values.items()]
    )
    found = numbered
    for out, (src, _) in values.items():
        rows = df.select(F.col(key).alias("_key"), F.col(order).alias("_order"), F.col(src).alias(out))
        there = found[key].eqNullSafe(rows["_key"]) & (found[f"_at_{out}"] == rows["_order"])
        found = found.join(rows, there, "left").drop("_key", "_order")
    return found.select(key, *values)


def global_ranks(df: DataFrame, score: str, tie: str, *, rule: HotRule = DEFAULT_RULE) -> DataFrame:
    """Rank all rows by an integer `score`, highest first, ties numbered by the unique key `tie`.

    Adds `rank_with_gaps`, `rank_no_gaps`, `row_num`, `rows_below` (rows with a smaller score) and `all_rows`. Works on the
    histogram of scores, one row per distinct value, so equal scores never meet in one task; only the numbering inside
    one score touches rows, and it is chunked when that score is hot.
    """
    histogram = (
        df.groupBy(score)
        .agg(F.count(F.lit(1)).alias("_here"))
        .withColumn("_down", -F.col(score).cast("long"))
    )
    total = histogram.agg(F.sum("_here")).scalar()
    ranked = grouped_window(
        histogram,
        [],
        ["_down"],
        row_number="rank_no_gaps",
        running_sum={"_through": "_here"},
        rule=rule,
    ).select(
        score,
        (F.col("_through") - F.col("_here") + 1).alias("rank_with_gaps"),
        "rank_no_gaps",
        (total - F.col("_through")).alias("rows_below"),
        total.alias("all_rows"),
    )
    numbered = grouped_window(df, [score], [tie], row_number="_in_score", rule=rule)
    return (
        numbered.join(ranked, score)
        .withColumn("row_num", F.col("rank_with_gaps") - 1 + F.col("_in_score"))
        .drop("_in_score")
    )


def number_rows(df: DataFrame, order: str, out: str, rule: HotRule = DEFAULT_RULE) -> DataFrame:
    """Number all rows from 1 by a unique column, without a single-task sort of a large input."""
    return grouped_window(df, [], [order], row_number=out, rule=rule)
