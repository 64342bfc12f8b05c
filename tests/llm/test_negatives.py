import random

import numpy as np
import pytest

from lendframe.llm import negatives, queries
from tests.compare import differences

TABLE = "vec_id long, embedding array<float>, label int, block long, size string, anchor_id string, vector string, windows int"


def make_vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, 1, "s", "a", "v", 2) for i, v, label in rows], TABLE)


def usable(rows, scale=256):
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            vector = [int(np.floor(scale * float(np.float32(x)))) for x in v]
            yield i, (label + 1) % 10 if i % 7 == 0 else label, vector


def brute(rows, step=50, positives=5, negatives=3):
    rows = list(usable(rows))
    anchors = {}
    for i, label, v in rows:
        if i % step == 0:
            anchors[i] = min(anchors.get(i, (label, v)), (label, v))
    out = []
    for a, (label, v) in anchors.items():
        scored = [(-sum(x * y for x, y in zip(v, w, strict=True)), i, own == label) for i, own, w in rows if i != a and len(w) == len(v)]
        for score, positive, _ in sorted(s for s in scored if s[2])[:positives]:
            fit = sorted(s for s in scored if not s[2] and -50 * score <= -100 * s[0] <= -95 * score)
            out += [(a, positive, rank, n[1], -score, -n[0]) for rank, n in enumerate(fit[:negatives], 1)]
    return sorted(out)


def found(df, **more):
    names = "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    return sorted(tuple(r[c] for c in names) for r in negatives.hard_negatives(df, **more).collect())


def test_equals_sql(spark, sf_dir):
    name = "op13_hard_negatives"
    assert not differences(spark, sf_dir, queries.queries()[name], queries.oracle_sql()[name])


@pytest.fixture(scope="module")
def clustered():
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(6, 20))
    return [(i, (centres[i % 6] + 0.4 * draw.normal(size=20)).tolist(), int(i % 6 * (i % 11 > 1))) for i in range(600)]


@pytest.mark.parametrize(("block", "step"), [(4096, 50), (16, 10), (64, 25)])
def test_equals_all_pairs(spark, clustered, block, step):
    want = brute(clustered, step)
    assert want and found(make_vectors(spark, clustered), step=step, block=block) == want


def test_other_sizes_of_results(spark, clustered):
    assert found(make_vectors(spark, clustered), positives=2, negatives=7, block=32) == brute(clustered, 50, 2, 7)


def test_odd_rows(spark):
    draw = random.Random(1)
    rows = [(i, [draw.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(3)], draw.randrange(3)) for i in range(120)]
    rows += [(None, [1.0, 1.0, 1.0], 1), (201, None, 1), (202, [1.0, None, 0.0], 1), (203, [float("nan"), 0.0, 0.0], 1)]
    rows += [(204, [float("inf"), 0.0, 0.0], 1), (205, [1.0, 1.0, 1.0], None), (206, [1.0, 1.0], 1), (250, [1.0, 1.0], 1)]
    rows += [(207, [0.6, 1.0], 2), (208, [], 1), (300, [], 2), (350, [3.0e38, 0.0, 1.0], 1), (-50, [1.0, 0.5, 0.5], 0)]
    rows = [r for r in rows if r[0] != 350]  # products of such components pass 64 bits
    rows += rows[40:60] + [(50, [0.5, 0.5, 0.5], 2), (50, [0.5, 0.5, 0.5], 0)]
    df = make_vectors(spark, rows)
    assert found(df) == brute(rows)
    assert found(df, step=5, block=8) == brute(rows, 5)
    assert not found(df.limit(0))
    assert not found(make_vectors(spark, [(0, [1.0], 1)]))


def test_bounds_hold_and_shrink():
    """The scan keeps the best of every window, and on clustered vectors it leaves most rows before the last column."""
    draw = np.random.default_rng(0)
    centres = draw.integers(-200, 200, (8, 64))
    points = np.concatenate([c + draw.integers(-20, 20, (100, 64)) for c in centres])
    columns = np.ascontiguousarray(points.T)
    block = negatives.Block(np.arange(800), np.zeros(800, np.int64), columns, columns.min(axis=1), columns.max(axis=1))
    anchor = points[5]
    scores = points @ anchor
    low, high = np.array([scores.max() // 2, negatives.LEAST]), np.array([scores.max() * 95 // 100, negatives.GREATEST])
    rows, exact = negatives.scan(anchor, block, np.arange(800) != 5, 3, low, high)
    assert (scores[rows] == exact).all() and len(rows) < 400
    for lo, hi in zip(low, high, strict=True):
        fit = np.flatnonzero((scores >= lo) & (scores <= hi) & (np.arange(800) != 5))
        assert set(fit[np.argsort(-scores[fit], kind="stable")][:3].tolist()) <= set(rows.tolist())
