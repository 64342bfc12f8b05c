"""Exact top-k inner products by dual-tree search over cover trees.

Queries and candidates are dealt into blocks of bounded size, and each block of queries meets each block of candidates in
one task. There both get a cover tree: a node has a centre and a covering radius, its children's centres are picked farthest
first, so they lie further apart than the radius they cover. A pair of nodes is left out if the largest inner product that
its radii allow is below the worst k-th score of the queries in the group. The best k of each block are merged at the end.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lendframe.llm.tables import send_code

SCALE, TOP, QUERY_STEP = 1024, 10, 100
CANDIDATE_BLOCK, QUERY_BLOCK = 1 << 14, 1 << 11
FANOUT, QUERY_LEAF, LEAF = 24, 16, 256
USEFUL = 0.8  # a node is split if its children cover less than this part of its radius

PARTIAL = "query_id long, vec_id long, score long"


class Node:
    __slots__ = ("centre", "norm", "radius", "rows", "children")

    def __init__(self, points: np.ndarray, rows: np.ndarray, centre: int, leaf: int):
        self.centre, self.rows = points[centre], rows
        self.norm = float(np.sqrt(self.centre @ self.centre))
        gap = points[rows] - self.centre
        away = np.sqrt(np.einsum("ij,ij->i", gap, gap))
        self.radius, self.children = float(away.max()), []
        if len(rows) <= leaf or self.radius == 0.0:
            return
        # Farthest first: each new centre is the point that is covered worst, until half the radius covers all.
        of, centres = np.zeros(len(rows), np.int64), [centre]
        # No more children than fill leaves to a quarter, or they would end up with a few rows each.
        most = max(2, min(FANOUT, 4 * len(rows) // leaf))
        while len(centres) < most and away.max() > self.radius / 2:
            new = int(away.argmax())
            gap = points[rows] - points[rows[new]]
            to_new = np.sqrt(np.einsum("ij,ij->i", gap, gap))
            closer = to_new < away
            of[closer], away = len(centres), np.minimum(away, to_new)
            centres.append(int(rows[new]))
        if away.max() > USEFUL * self.radius:
            return
        for k, own in enumerate(centres):
            members = rows[of == k]
            if len(members):
                self.children.append(Node(points, members, own, leaf))


class Search:
    """The best `k` candidates of each query of a block; equal scores go to the smaller id, a query's own id is left out."""

    def __init__(self, q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, points: np.ndarray, k: int):
        self.q_ids, self.q, self.ids, self.points, self.k = q_ids, q, ids, points, k
        largest = float(np.abs(q).max(initial=0)) * float(np.abs(points).max(initial=0)) * q.shape[1]
        # Sums of integers are exact in doubles below 2**53; the bounds allow for their rounding.
        self.exact = np.float64 if largest < 1 << 53 else np.int64
        self.fq, self.fp = q.astype(np.float64), points.astype(np.float64)
        self.slack = 1e-9 * max(1.0, largest)
        self.scores = np.full((len(q), k), np.iinfo(np.int64).min)
        self.found = np.full((len(q), k), np.iinfo(np.int64).max)
        queries, candidates = np.arange(len(q)), np.arange(len(points))
        self.visit(Node(self.fq, queries, 0, QUERY_LEAF), Node(self.fp, candidates, 0, LEAF))

    def bounds(self, query: Node, nodes: list[Node]) -> np.ndarray:
        centres = np.array([n.centre for n in nodes])
        norms, radii = (np.array([getattr(n, name) for n in nodes]) for name in ("norm", "radius"))
        return centres @ query.centre + query.radius * norms + radii * query.norm + query.radius * radii + self.slack

    def visit(self, query: Node, node: Node) -> None:
        stack = [(float(self.bounds(query, [node])[0]), query, node)]
        while stack:
            bound, query, node = stack.pop()
            worst = self.scores[query.rows, -1].min()
            if bound < worst:
                continue
            if not query.children and not node.children:
                self.compare(query.rows, node.rows)
            elif query.children and (query.radius >= node.radius or not node.children):
                stack += [(float(self.bounds(child, [node])[0]), child, node) for child in query.children]
            else:
                bounds = self.bounds(query, node.children)
                # The most promising candidates come off the stack first.
                stack += [(float(bounds[i]), query, node.children[i]) for i in np.argsort(bounds, kind="stable")]

    def compare(self, rows: np.ndarray, others: np.ndarray) -> None:
        source = (self.fq, self.fp) if self.exact is np.float64 else (self.q, self.points)
        scores = (source[0][rows] @ source[1][others].T).astype(np.int64)
        # Only scores that reach the k-th so far, and the k-th of these (or the next, if a query's own is among them).
        least = self.scores[rows, -1]
        if len(others) > self.k + 1:
            least = np.maximum(least, np.partition(scores, -self.k - 1, axis=1)[:, -self.k - 1])
        hits, at = np.nonzero(scores >= least[:, None])
        ids = self.ids[others[at]]
        other = ids != self.q_ids[rows[hits]]
        hits, ids, values = hits[other], ids[other], scores[hits[other], at[other]]
        cuts = np.searchsorted(hits, np.arange(len(rows) + 1))
        for n in np.flatnonzero(np.diff(cuts)):
            row, new = rows[n], slice(cuts[n], cuts[n + 1])
            merged, named = np.append(self.scores[row], values[new]), np.append(self.found[row], ids[new])
            best = np.lexsort((named, ~merged))[: self.k]
            self.scores[row], self.found[row] = merged[best], named[best]


def _search(queries: pd.DataFrame, candidates: pd.DataFrame, k: int) -> pd.DataFrame:
    if not len(queries) or not len(candidates):
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
    q, points = (np.stack(x["vector"].to_numpy()).astype(np.int64) for x in (queries, candidates))
    ids = candidates["vec_id"].to_numpy(np.int64)
    if not q.shape[1]:
        q, points = np.zeros((len(q), 1), np.int64), np.zeros((len(points), 1), np.int64)
    done = Search(queries["vec_id"].to_numpy(np.int64), q, ids, points, k)
    there = done.found != np.iinfo(np.int64).max
    return pd.DataFrame(
        {
            "query_id": np.repeat(queries["vec_id"].to_numpy(np.int64), there.sum(axis=1)),
            "vec_id": done.found[there],
            "score": done.scores[there],
        }
    )


def integer_vectors(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, vector): floor(scale * x) of each component; rows with a null id or an unusable vector are left out."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    usable = embeddings.where(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)))
    vector = F.transform(x, lambda v: F.floor(v * scale).cast("long"))
    return usable.select(F.col("vec_id").cast("long"), vector.alias("vector"))


def top_k(embeddings: DataFrame, k: int = TOP, step: int = QUERY_STEP, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of each vector whose id is divisible by `step`.

    Rows whose id is null, or whose vector is null or holds a null, NaN or infinity, take no part. Vectors of different
    lengths are not compared. A row is no candidate for a query of its own id; repeated candidate rows count each, of
    repeated query rows one is asked (the smallest vector). A query with fewer candidates gets them all; without queries or
    candidates the result is empty. Other columns are not read.
    """
    send_code(embeddings.sparkSession)
    vectors = integer_vectors(embeddings, scale).withColumn("size", F.size("vector"))
    asked = vectors.where(F.col("vec_id") % step == 0).groupBy("vec_id", "size").agg(F.min("vector").alias("vector"))
    n_rows, n_asked = (max(1, df.count()) for df in (vectors, asked.select("vec_id")))
    blocks, parts = -(-n_rows // CANDIDATE_BLOCK), -(-n_asked // QUERY_BLOCK)

    def dealt(df: DataFrame, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
        df = df.withColumn(own, F.pmod(F.xxhash64("vec_id"), F.lit(n_own)))
        return df.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_other - 1).cast("long"))))

    keys = ["size", "part", "block"]
    queries = dealt(asked, "part", parts, "block", blocks).groupBy(*keys)
    candidates = dealt(vectors, "block", blocks, "part", parts).groupBy(*keys)

    def search(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        return _search(queries, candidates, k)

    found = queries.cogroup(candidates).applyInPandas(search, PARTIAL)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")  # k rows of each block
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


SQL = """
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM vectors q JOIN vectors c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
  FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
