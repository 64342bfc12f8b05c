"""Searching for a table of terms equals comparing every term with every row."""

import random

import pytest

from lendframe.operators import term_search
from lendframe.operators.term_search import TermIndex, rows_with_terms, search_terms
from tests.builders import library


def brute(rows, terms, columns):
    return sorted(
        (t, r["id"]) for t in {t for t in terms if t is not None} for r in rows
        if any(t.lower() in (r[c] or "").lower() for c in columns)
    )


def asked(spark, terms):
    return spark.createDataFrame([(t,) for t in terms], "term string")


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(2)
    letters = ["a", "b", "É", "é", "日", "😀", "%", "_", " "]
    made = [{"id": i, "x": "".join(draw.choices(letters, k=draw.randint(0, 9))), "y": draw.choice([None, "", "ab", "Ba%"])} for i in range(150)]
    return [*made, {"id": 900, "x": None, "y": None}, {"id": 901, "x": "a" * 50_000 + "needle", "y": "b"}]


def test_equals_all_pairs(spark, rows):
    draw = random.Random(3)
    df = spark.createDataFrame([(r["id"], r["x"], r["y"]) for r in rows], "id long, x string, y string")
    index = TermIndex(df, "id", ["x", "y"])
    letters = ["a", "B", "é", "日", "😀", "%", "_", " "]
    terms = ["".join(draw.choices(letters, k=k)) for k in (0, 1, 1, 2, 2, 3, 3, 4, 5, 6) for _ in range(8)]
    terms += [None, "", "NEEDLE", "aaaa", "aab", "not there", "ab", "AB", "%", "a_", "\u0000"]
    got = sorted(tuple(r) for r in index.search(asked(spark, terms)).collect())
    assert got == brute(rows, terms, ["x", "y"])


def test_nothing_asked_and_nothing_there(spark, rows):
    df = spark.createDataFrame([(1, "a")], "id long, x string")
    assert not TermIndex(df, "id", ["x"]).search(asked(spark, [])).collect()
    assert not TermIndex(df.limit(0), "id", ["x"]).search(asked(spark, ["", "a", "abc"])).collect()


def test_no_nested_loops(spark, rows):
    df = spark.createDataFrame([(r["id"], r["x"], r["y"]) for r in rows], "id long, x string, y string")
    plan = TermIndex(df, "id", ["x", "y"]).search(asked(spark, ["abc", "a"]))._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_a_frequent_gram_is_read_only_for_terms_without_a_rarer_one(spark):
    df = spark.createDataFrame([(i, "common" + (" rare" if i == 7 else "")) for i in range(300)], "id long, x string")
    index = TermIndex(df, "id", ["x"])
    lists = {r["gram"]: r["rows"] for r in index.lists.collect()}
    assert lists["com"] == 300 and lists["on "] == 1
    assert [tuple(r) for r in index.search(asked(spark, ["COMMON RARE"])).collect()] == [("COMMON RARE", 7)]


def test_books_and_members(spark):
    lib = library(
        spark,
        books=[{"title": "Ring of Stars", "author": "Ann"}, {"title": "Other", "author": "Bering"}],
        members=[{"full_name": "Ringo", "email": "r@x"}, {"full_name": "Paul", "email": "p@ring.org"}],
    )
    found = {tuple(r) for r in search_terms(lib.books, lib.members, asked(spark, ["ring", "an", "zz"])).collect()}
    assert found == {
        ("ring", "book", 1, "Ring of Stars", "Ann"), ("ring", "book", 2, "Other", "Bering"), ("an", "book", 1, "Ring of Stars", "Ann"),
        ("ring", "member", 1, "Ringo", "r@x"), ("ring", "member", 2, "Paul", "p@ring.org"),
    }
    rows = rows_with_terms(lib.books.select("book_id", "title"), "book_id", ["title"], asked(spark, ["STARS"])).collect()
    assert [tuple(r) for r in rows] == [("STARS", 1, "Ring of Stars")]


def test_grams_of_a_table_in_one_partition_are_made_by_several_tasks(spark, monkeypatch):
    """all grams of a table of one file were made by one task."""
    made = []
    monkeypatch.setattr(term_search, "written", lambda df, folder: made.append(df) or df)
    TermIndex(spark.range(100).selectExpr("id", "cast(id AS string) AS x").coalesce(1), "id", ["x"])
    plan = made[0]._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Generate"):]
    assert "RepartitionByExpression [id" in below
