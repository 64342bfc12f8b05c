import re

import corpus_pipeline as pipeline
from lendframe.llm import queries
from tests.llm.conftest import make_docs
from tests.llm.test_dedup import brute_groups
from tests.llm.test_filters import brute_pii


def test_names():
    numbers = [int(re.match(r"op(\d+)_", n)[1]) for n in queries.queries()]
    assert numbers == list(range(1, 14))
    assert [n for n, _ in pipeline.STAGES] == ["quality_rules", "near_dedup", "personal_data", "mixing", "encoding"]


def test_stages_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, docs
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, kept, sf_dir).cache()
        assert out.columns == columns and out.dtypes == docs.dtypes
        before, after = ([(r.doc_id, r.text) for r in d.collect()] for d in (kept, out))
        if name == "quality_rules":
            assert set(after) < set(before) and all(len(t.split()) >= 50 for _, t in after)
        if name == "near_dedup":
            groups = brute_groups(before, 5)
            assert sorted(i for i, _ in after) == sorted({groups[i] for i, _ in before})
        if name == "personal_data":
            assert len(after) == len(before) and not any(brute_pii(t) for _, t in after)
            assert all(r.n_chars == len(r.text) for r in out.collect())
        if name == "mixing":
            assert set(after) <= set(before) and max(map(after.count, set(after))) <= 3
        kept = out
    last = pipeline.STAGES[-1][1](spark, kept, sf_dir)
    assert last.count() == kept.count() and {"doc_id", "n_tokens", "ids"} <= set(last.columns)


def test_run_is_the_stages_in_order(spark, sf_dir):
    first = pipeline.run(spark, sf_dir).select("doc_id", "ids_sha256").collect()
    again = pipeline.run(spark, sf_dir).select("doc_id", "ids_sha256").collect()
    assert sorted(first) == sorted(again) and first


def test_stages_of_odd_rows(spark, odd_docs, no_docs, sf_dir):
    for name, stage in pipeline.STAGES:
        assert stage(spark, no_docs, sf_dir).count() == 0, name
        found = stage(spark, odd_docs, sf_dir)
        assert found.count() <= 3 * odd_docs.count(), name
        if name != "encoding":
            assert found.columns == odd_docs.columns
    deduped = pipeline.near_dedup(spark, odd_docs, sf_dir)
    assert sorted(r.doc_id or -1 for r in deduped.collect()) == [-1, -1, 1, 2, 3, 4, 5, 6, 8, 9]


def test_near_dedup_keeps_texts_of_one_doc_id_apart(spark, prose):
    """Two texts under one id are two documents, whatever order the rows come in; copies of them go."""
    some, other = prose(80), prose(90)
    rows = [(6, some), (6, other), (7, some), (6, some), (8, other + " end"), (None, some)]
    for order in (rows, rows[::-1]):
        for parts in (1, 3):
            docs = make_docs(spark, order).repartition(parts)
            found = sorted((r.doc_id or -1, r.text) for r in pipeline.near_dedup(spark, docs, "").collect())
            assert found == sorted([(-1, some), (6, some), (6, other)])
