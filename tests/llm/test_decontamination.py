import hashlib
import random
import re

import pytest

from lendframe.llm import postings, queries
from tests.compare import differences
from tests.llm.conftest import make_docs

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string, words string, w long, row string, n long, phrase string"


def make_items(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "r", 2, "p") for i, t in rows], ITEMS)


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(low)


def brute(docs, items, window=10):
    windows = {}
    for item, text in items:
        have = words(text)
        if item is None or not have:
            continue
        size = min(window, len(have))
        for s in range(len(have) - size + 1):
            windows.setdefault(tuple(have[s : s + size]), set()).add(str(item))
    out = []
    for doc_id, text in docs:
        have, hit, found = words(text), set(), set()
        for size in {len(w) for w in windows}:
            for s in range(len(have) - size + 1):
                if named := windows.get(tuple(have[s : s + size])):
                    hit.update(range(s, s + size))
                    found |= named
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc_id, len(have), len(hit), len(found), sha, bool(hit)))
    return sorted(out, key=repr)


def found(docs, items, **more):
    rows = postings.decontamination(docs, items, **more).collect()
    names = "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"
    return sorted((tuple(r[n] for n in names) for r in rows), key=repr)


def test_equals_sql(spark, sf_dir):
    name = "op11_decontamination"
    assert not differences(spark, sf_dir, queries.queries()[name], queries.oracle_sql()[name])


@pytest.fixture(scope="module")
def small():
    """Texts over few words, so that windows overlap, repeat and share their terms."""
    draw = random.Random(3)
    letters = ["a", "B", "c", "É", "日", "x1"]
    docs = [(i, " ".join(draw.choices(letters, k=draw.randint(0, 60)))) for i in range(60)]
    docs += [(7, docs[7][1]), (None, docs[8][1]), (None, docs[8][1]), (8, docs[9][1])]
    items = [(i, " ".join(draw.choices(letters, k=draw.randint(0, 9)))) for i in range(12)]
    items += [(3, docs[1][1]), (None, docs[2][1]), (40, docs[8][1]), (41, docs[8][1]), (-5, "zzz a b"), (50, None)]
    return docs, items


@pytest.mark.parametrize("window", [1, 2, 4, 10])
def test_equals_all_windows(spark, small, window):
    docs, items = small
    assert found(make_docs(spark, docs), make_items(spark, items), window=window) == brute(docs, items, window)


def test_odd_rows(spark, odd_docs, no_docs, prose):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    items = [(1, prose(5)), (2, rows[6][1][200:700]), (3, "WORD"), (4, ""), (5, "x" * 3000), (6, rows[0][1])]
    assert found(odd_docs, make_items(spark, items)) == brute(rows, items)
    assert not found(no_docs, make_items(spark, items))
    assert found(odd_docs, make_items(spark, [])) == brute(rows, [])


def test_without_broadcasts(spark, small, monkeypatch):
    docs, items = small
    monkeypatch.setattr(postings, "BROADCAST_ROWS", 0)
    assert found(make_docs(spark, docs), make_items(spark, items)) == brute(docs, items)


def test_passages_are_the_places_of_the_windows(spark):
    docs = [(1, "zero One two THREE four five"), (2, "three two one")]
    rows = postings.passages(make_docs(spark, docs), make_items(spark, [(9, "one two three"), (8, "Four Five")])).collect()
    assert sorted(map(tuple, rows)) == [(1, "8", 4, 6), (1, "9", 1, 4)]


@pytest.mark.parametrize("within", [3, 5, 8])
def test_nearby_equals_all_stretches(spark, small, within):
    docs, items = small
    docs, items = docs[:25], items[:8]
    want = set()
    for item, text in items:
        have = words(text)
        size = min(3, len(have))
        for phrase in {tuple(have[s : s + size]) for s in range(len(have) - size + 1)} if have else ():
            for doc_id, body in docs:
                place = words(body)
                fits = [
                    (n, s, s + n)
                    for s in range(len(place))
                    for n in range(1, within + 1)
                    if s + n <= len(place) and set(phrase) <= set(place[s : s + n])
                ]
                if fits:
                    want.add((doc_id, str(item), " ".join(phrase), *min(fits)[1:]))
    rows = postings.nearby(make_docs(spark, docs), make_items(spark, items), window=3, within=within).collect()
    assert {tuple(r) for r in rows} == want and len(rows) == len(want)


def test_no_python_on_the_way(spark, small):
    docs, items = small
    plan = postings.decontamination(make_docs(spark, docs), make_items(spark, items))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
