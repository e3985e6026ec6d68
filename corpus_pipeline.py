"""From raw documents to token ids: five stages, each one operator of ``treemill.llm``.

Every stage takes what the one before it kept, as a table with the columns of ``documents``, and
returns the same columns; the last one returns encodings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from treemill.llm import bpe, exact_dedup, mixing, quality_rules, simhash
from treemill.llm.common import discard, documents, stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the learned decision list reject go."""
    return quality_rules.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the largest doc_id stays."""
    return exact_dedup.drop_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the least doc_id stays."""
    return simhash.drop_near_copies(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces that the slots of the mix hold, in the order of slots."""
    return mixing.mixed_texts(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests and ids of every text of the mix."""
    return bpe.encoded_digests(docs, ids=True)


STAGES = [("quality rules", quality), ("exact dedup", exact), ("near dedup", near), ("source mixing", mixed), ("bpe", encoded)]

#: The learned rules, the hashed order of the mix and BPE are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; of the tables between stages only the last one stays."""
    docs = documents(spark, sf_dir)
    for n, (_, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, stored(stage(spark, docs, sf_dir))
        if n:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
