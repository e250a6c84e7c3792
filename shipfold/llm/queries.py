"""The registered queries of the training-data operators, with production parameters.

Each reads its whole table from ``sf_dir``. ``ORACLE`` holds DuckDB SQL where SQL
can express the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shipfold.llm.adaptive_scan import nearest_neighbours
from shipfold.llm.best_fit import best_fit
from shipfold.llm.common import read_table
from shipfold.llm.exact_dedup import exact_dedup
from shipfold.llm.language_id import identify_tables
from shipfold.llm.license_scan import license_scan
from shipfold.llm.merkle import every_third, manifest
from shipfold.llm.merkle import oracle as merkle_oracle
from shipfold.llm.pii_crf import find_pii
from shipfold.llm.simhash_vp import simhash_components
from shipfold.llm.source_mix import source_mix
from shipfold.llm.token_count import token_counts
from shipfold.llm.url_filter import filter_urls
from shipfold.llm.url_filter import oracle as url_oracle
from shipfold.llm.whitening import whiten
from shipfold.llm.zstd_quality import quality_scores


def op1_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(read_table(spark, sf_dir, "documents"))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix(read_table(spark, sf_dir, "documents"))


def op3_adaptive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(read_table(spark, sf_dir, "embeddings"), F.pmod(F.col("id"), F.lit(20)) == 0)


def op4_zstd_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op5_simhash_vp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(read_table(spark, sf_dir, "documents"))


def op6_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_tables(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "pages"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's path is its source, its language and its id."""
    path = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    return license_scan(read_table(spark, sf_dir, "documents"), path)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read_table(spark, sf_dir, "documents"))


def op10_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit(read_table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(read_table(spark, sf_dir, "embeddings"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return manifest(docs, every_third(docs))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules' verdicts label the URLs that they decide."""
    return filter_urls(read_table(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (
    op1_pii_crf, op2_source_mix, op3_adaptive_scan, op4_zstd_quality, op5_simhash_vp, op6_token_count, op7_language_id,
    op8_license_scan, op9_exact_dedup, op10_best_fit, op11_whitening, op12_merkle_manifest,
    op13_url_filter)}

ORACLE = {
    "op9_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op12_merkle_manifest": merkle_oracle(),
    "op13_url_filter": url_oracle(),
}
