import random

import pyarrow.parquet as pq
import pytest

CLASHING = "n long, node long, key string, value long, a long, b long, size long, source_size long, row string, kept string, trustedid long, Trusted string, TRUSTED_ID string, component_id long"
DOCS = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}"


def make_docs(spark, rows):
    """(doc_id, text[, source]) with columns whose names the operators use themselves."""
    full = [(i, t, "en", (s or ["src0"])[0], len(t or ""), 1, 2, "k", 3, 4, 5, 6, 7, "r", "x", 8, "t", "u", 9) for i, t, *s in rows]
    return spark.createDataFrame(full, DOCS)


@pytest.fixture(scope="session")
def prose():
    """Sentences of invented words, the same in every run."""
    draw = random.Random(7)
    syllables = ["ta", "re", "mon", "li", "su", "ka", "é", "ñu", "dor", "wen", "fi", "pra"]

    def words(n):
        return " ".join("".join(draw.choices(syllables, k=draw.randint(1, 4))) for _ in range(n))

    return words


@pytest.fixture(scope="session")
def odd_docs(spark, prose):
    """Nulls, empty and very long texts, ties, repeated rows."""
    long = prose(30_000)
    some = prose(120)
    rows = [
        (None, some, ["a"]),
        (None, None, [None]),
        (1, None, ["a"]),
        (2, "", ["b"]),
        (3, " \t\n\r ", [None]),
        (4, "word", ["b"]),
        (5, long, ["c"]),
        (6, some, ["a"]),
        (6, some, ["a"]),
        (7, some, ["c"]),
        (8, "x" * 3000, ["b"]),
        (9, "ž€😀     end", ["b"]),
    ]
    return make_docs(spark, rows)


@pytest.fixture(scope="session")
def no_docs(spark):
    return make_docs(spark, [])


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame(
        [(6, 1, 0), (6, 1, 0), (7, 0, 0), (None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int"
    )


@pytest.fixture(scope="session")
def given(spark, sf_dir):
    """Rows of the given documents as (doc_id, text), and the frame."""
    table = pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text"])
    return list(zip(*(c.to_pylist() for c in table.columns), strict=True)), spark.read.parquet(
        f"{sf_dir}/documents.parquet"
    )
