"""From raw documents to token ids: five stages, each reading what the one before wrote.

1. Language ID: documents without a letter, or unlike every known language, go.
2. N-gram Jaccard join: of each group of near copies the smallest doc_id stays.
3. Secret scans: every span that is found is replaced by a mark.
4. Mixing: sources are drawn to their target weights; a document is in once per epoch.
5. Byte-level BPE: texts become ids, which are decoded again for the digest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orrery.llm import bpe, hyperlang, mixing, prefix_tree, secrets
from orrery.llm.common import staged
from orrery.staging import ship


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return hyperlang.in_known_language(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return prefix_tree.one_of_each(docs)


def secret_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return secrets.redacted(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return mixing.mixed_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return bpe.encode(docs, with_digests=True)


STAGES = [
    ("language_id", language),
    ("ngram_jaccard_join", near_copies),
    ("secret_scan", secret_spans),
    ("mix_sources", mixture),
    ("byte_bpe", token_ids),
]

#: No SQL: hyperdimensional profiles and guess costs have none. tests/llm checks the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
