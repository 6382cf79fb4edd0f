"""The corpus pipeline: from documents to packed training sequences."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.exact_dedup import drop_exact_copies
from tidemark.llm.mixing import mixed_documents
from tidemark.llm.near_dedup import drop_near_copies
from tidemark.llm.packing import pack_documents
from tidemark.llm.toxicity import drop_toxic
from tidemark.plans.scratch import cut, delete, release, tidy
from tidemark.session import ship


def stage(operator: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage that deletes the tables it made and its result doesn't read; those that it reads are in its _left.

    The result may be read as often as one likes, chained to further stages too, and nothing else deletes what it reads.
    """

    @wraps(operator)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        out, left = tidy(lambda: operator(spark, docs, sf_dir))
        out._left = left
        return out

    return run_stage


@stage
def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity network, fitted to labels, doesn't reject.

    Null and empty texts are scored like others (one empty window); null keys, repeated rows and other columns stay.
    Without labels, or with one kind of them that isn't toxic, all stay. No rows give none.
    """
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@stage
def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: that with the smallest doc_id, null last.

    Null and empty texts are equal; of rows that repeat the smallest doc_id one stays. No rows give none.
    """
    return drop_exact_copies(docs)


@stage
def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at similarity 0.8 of five-word shingles: that with the smallest doc_id, null last.

    Texts without words, null ones too, all stay; of rows that repeat the smallest doc_id one stays. No rows give none.
    """
    return drop_near_copies(docs)


@stage
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, at most three times.

    Texts without words, null ones too, have nothing to take and leave; null sources are a source; null keys and
    repeated rows are documents like any other. No rows give none.
    """
    return mixed_documents(docs)


@stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 tokens.

    Null and empty texts are a piece of one token, the end id; null keys stay null; repeated rows are packed each. Other
    columns are not read. No rows give none.
    """
    return pack_documents(docs, 4096)


STAGES = [
    ("toxicity", without_toxic),
    ("exact dedup", without_copies),
    ("MinHash near-dedup", without_near_copies),
    ("mixing sources", mixed),
    ("best-fit packing", packed),
]

#: SQL can't express the first stage, a trained network.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each reads what the one before wrote."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, each) in enumerate(STAGES):
        docs = each(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            made = docs._left
            docs = cut(docs, f"stage-{k}")
            delete(spark, made)
            if before is not None:
                release(before)
            before = docs
    return docs
