"""Following links equals walking them one by one."""

import math
import random

import pytest

from lendframe.operators import links as links_module
from lendframe.operators.links import follow_links, linked_reservations
from tests.builders import library


def walk(links):
    out = {}
    for node in links:
        seen, at = [], node
        while at in links and links[at] is not None and at not in seen:
            seen.append(at)
            at = links[at]
        if links[node] is None:
            continue
        if at in seen:
            out[node] = (min(seen[seen.index(at) :]), None, True)
        else:
            out[node] = (at, len(seen), False)
    return out


def followed(spark, links):
    rows = follow_links(spark.createDataFrame(list(links.items()), "node long, target long")).collect()
    assert len(rows) == len({r.node for r in rows})
    return {r.node: (r.end, r.steps, r.cyclic) for r in rows}


@pytest.mark.parametrize("seed", range(4))
def test_equals_walking(spark, seed):
    draw = random.Random(seed)
    n = 120
    links = {i: draw.choice([draw.randrange(n), draw.randrange(n), i + 1, 1000 + i, None]) for i in range(n) if draw.random() < 0.95}
    assert followed(spark, links) == walk(links)


def test_one_long_chain_takes_logarithmic_rounds(spark, monkeypatch):
    rounds = []
    real = links_module.written
    monkeypatch.setattr(links_module, "written", lambda df, folder: rounds.append(folder) or real(df, folder))
    links = {i: i + 1 for i in range(500)}
    assert followed(spark, links) == {i: (500, 500 - i, False) for i in range(500)}
    assert len(rounds) <= 2 + math.ceil(math.log2(500)) + 1


def test_cycles_loops_and_a_hub(spark):
    links = {0: 0, 1: 2, 2: 3, 3: 1, 4: 3, 5: 4, **{i: 7 for i in range(10, 300)}, 7: 8, 8: None}
    assert followed(spark, links) == walk(links)
    assert followed(spark, {}) == {}


def test_reservations_with_gaps(spark):
    places = {1: [1, 2, 3, 5, 6], 2: [2, 3], 3: [1], 4: [1, 3]}
    rows = [{"book_id": b, "queue_position": p} for b, ps in places.items() for p in reversed(ps)]
    found = linked_reservations(library(spark, reservations=rows).reservations).collect()
    assert sorted((r.book_id, r.queue_position, r.depth) for r in found) == [(1, 1, 1), (1, 2, 2), (1, 3, 3), (3, 1, 1), (4, 1, 1)]
