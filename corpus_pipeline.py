"""The corpus pipeline: documents to packed sequences, one written table per stage.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written
as Parquet and read again as the next one's ``docs``; all but the last return the
columns of ``docs``. A lost executor re-reads the last written stage.

Null, empty and very long texts, ties, repeated rows, empty tables and extra
columns go through every stage as its operator's docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shipfold.llm.best_fit import best_fit
from shipfold.llm.common import read_table, write_scratch
from shipfold.llm.exact_dedup import keep_first_copies
from shipfold.llm.language_id import keep_identified
from shipfold.llm.simhash_vp import keep_one_of_each
from shipfold.llm.source_mix import mixed_documents

#: Tokens of several libraries and pseudorandom draws are not SQL.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose fused language is undetermined or in doubt go."""
    return keep_identified(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per text stays: the largest doc_id."""
    return keep_first_copies(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays: the smallest doc_id."""
    return keep_one_of_each(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix draws them: a row per document and pass."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece with its sequence and place."""
    return best_fit(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("simhash_dedup", simhash_dedup),
    ("source_mix", source_mix),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_scratch(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
