"""Connected components of an edge table.

Edges are dealt by a hash of both ends into partitions of about `BLOCK_EDGES`, so that those of a hub are spread, too; each task replaces its edges by stars around the smallest id
that it can reach with them. One partition is then done. Of several, alternating large-star and small-star steps move edges
towards the smallest id in reach, each an aggregation and a join, with the contraction inside partitions in between, until
every node hangs on the smallest id of its component. Nothing is collected per node or on the driver, so a component may
have any size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendframe.llm.tables import Store

BLOCK_EDGES = 1 << 20


def contract(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node in reach) of every node but those that are the smallest themselves."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        left, right = label[a], label[b]
        differ = left != right
        if not differ.any():
            break
        a, b, left, right = a[differ], b[differ], left[differ], right[differ]
        np.minimum.at(label, np.maximum(left, right), np.minimum(left, right))
        while np.any((onward := label[label]) != label):
            label = onward
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [(batch.column(0).to_numpy(), batch.column(1).to_numpy()) for batch in batches]
    if parts:
        a, b = contract(*(np.concatenate(c) for c in zip(*parts, strict=True)))
        yield pa.RecordBatch.from_pydict({"a": a, "b": b})


def _contracted(edges: DataFrame, parts: int) -> DataFrame:
    dealt = edges.repartition(1) if parts == 1 else edges.repartition(parts, F.xxhash64("a", "b"))
    return dealt.mapInArrow(_contract, "a long, b long")


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """edges: (a, b) with a > b. Large: connect the larger neighbours of each node with its smallest; small: the others."""
    if small:
        lowest = edges.groupBy("a").agg(F.min("b").alias("m"))
        moved = edges.join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        out = moved.unionByName(lowest.select("a", F.col("m").alias("b")))
    else:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.min("b").alias("m"))
        lowest = lowest.select("a", F.least("a", "m").alias("m"))
        out = both.where("b > a").join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # A node whose larger neighbours all moved away keeps its own edge to a smaller one.
        out = out.unionByName(lowest.where("m < a").select("a", F.col("m").alias("b")))
    return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame, store: Store) -> DataFrame:
    """(node, component) for every node that has an edge; component is the smallest node id in reach.

    Edges are (a, b) in any order and number; nulls and loops are ignored.
    """
    edges = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    edges = store.keep(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    parts = max(1, -(-edges.count() // BLOCK_EDGES))
    edges = store.keep(_contracted(edges, parts))
    summary = F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))"), F.sum(F.col("b") % 1_000_003)
    before, now = None, edges.agg(*summary).first() if parts > 1 else None
    while before != now:
        edges = store.keep(_contracted(_star(_star(edges, small=False), small=True), parts))
        before, now = now, edges.agg(*summary).first()
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
