"""The corpus pipeline: raw documents to packed token sequences, each stage written and read again.

Defined cases: null, empty and short texts fail the quality rules and go; repeated rows and near copies leave one
document (of equal texts the smallest doc_id); rows without a doc_id are documents of their own and stay in every stage
that judges them good; very long texts pass whole and are cut by the packing alone; columns other than those of
documents go through the first four stages unchanged; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tercet.llm.common import new_path, table
from tercet.llm.mixing import mixed_documents
from tercet.llm.ngram_join import one_of_each
from tercet.llm.packing import packed_pieces
from tercet.llm.quality import kept_documents
from tercet.llm.secrets import redacted


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words, similarity 0.8."""
    return one_of_each(docs, n=5, percent=80)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark."""
    return redacted(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Nine tenths of the tokens, split over domains, languages and sources by their weights."""
    return mixed_documents(docs, percent=90, max_epochs=1)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their place in sequences of 1024."""
    return packed_pieces(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mixing", mixing), ("packing", packing)]

#: The stages fit models and pack; SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
