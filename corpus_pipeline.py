"""A training corpus from raw documents, in five stages; each stage's rows are written as Parquet and read by the next.

Each function takes (spark, docs, sf_dir). All but the last return rows with the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkspark.llm import byte_bpe, exact_dedup, mixing, quality, queries, simhash
from inkspark.llm.shared import materialize


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects (score under 0.7) go. Where there is no label at all, nothing can be
    told and every document stays; where all labels are alike, all documents share their fate."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, quality.fit(docs, labels), 0.7)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id stays."""
    return exact_dedup.drop_exact_duplicates(docs)


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies the document with the smallest doc_id stays: fingerprints within 7 bits, verified by a
    Jaccard similarity of 0.8 or more on five-word shingles. Rows without a doc_id stay."""
    return simhash.drop_near_duplicates(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Small sources are repeated, at most 1.5 times; every document stays at least once."""
    return mixing.mix_documents(docs, max_repetition=1.5, budget=None)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row (doc_id, n_tokens, ids), with digests of the ids and of what they decode to."""
    return byte_bpe.encode(docs, queries.RANKS, queries.PATTERN)


STAGES = [
    ("quality classifier", good),
    ("exact dedup", distinct),
    ("SimHash near-dedup", unlike),
    ("mixing sources to target weights", mixed),
    ("byte-level BPE", encoded),
]

#: SQL expresses neither the classifier nor XXH64 fingerprints; tests/llm has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. A stage's input is dropped once its output is written; empty tables give no rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), docs)
    return STAGES[-1][1](spark, docs, sf_dir)
