"""A corpus from raw documents to token ids: quality, near-duplicates, personal data, mixing, encoding.

Every stage takes (spark, docs, sf_dir) and works on all rows of `docs`; its result is written as Parquet and read again
as the next one's `docs`. Columns that `docs` has besides those a stage needs stay as they are, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lendframe.llm.minhash import near_duplicates
from lendframe.llm.mixing import mix_documents
from lendframe.llm.pieces import encoded
from lendframe.llm.pii import masked_documents
from lendframe.llm.quality import kept_documents
from lendframe.llm.tables import Store


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep. Null and empty texts are rejected."""
    return kept_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, the one with the smallest doc_id; rows without doc_id stay.

    Rows are compared by their texts: of rows that repeat a doc_id, those with other texts stay, too. Rows are told apart by
    their place in `docs`, which is a table that was read.
    """
    row = "row"
    while row in {c.lower() for c in docs.columns}:
        row += "_"
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    named = numbered.where("doc_id IS NOT NULL")
    found = near_duplicates(named.select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias("row"), "component_id")
    found = found.join(named.select(F.col(row).alias("row"), F.col("doc_id").alias("id")), "row")
    kept = found.groupBy("component_id").agg(F.min(F.struct("id", "row")).alias("first")).select(F.col("first.row").alias(row))
    stay = named.join(kept, row, "left_semi").select(*docs.columns)
    return stay.unionByName(docs.where("doc_id IS NULL"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the name of its kind in place of personal data, and n_chars of the new text."""
    masked = masked_documents(docs)
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return masked


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy of a document that the mix takes."""
    return mix_documents(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number and digests of the ids, and the ids of every copy."""
    return encoded(docs, public_tokenizers.path("piece_bpe_32k.model"), with_ids=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("personal_data", personal_data),
    ("mixing", mixing),
    ("encoding", encoding),
]

# Hashed models and tokenizers decide in several stages; tests compare each with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Store(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = store.keep(stage(spark, docs, sf_dir))
    return docs
