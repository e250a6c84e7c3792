"""Contains filters over many rows by an index of three-letter grams.

The index is a table ``gram, id`` with one row per different gram of a row's text,
sorted by both in files by the gram's hash (a gram of a third of all rows is spread over
several), and the grams' row counts. A search reads the postings of its pattern's rarest grams alone; the rows that
have them all are candidates, and the filter itself decides on them. A pattern with no
three letters in a row between its wildcards is answered by the filter over all rows.

Ids are unique and not null. Rows whose text is null or shorter than a gram have no posting.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shipfold.functions.text import lower_ascii
from shipfold.operators.filters import contains_filter, like_filter

GRAM = 3
#: Grams whose postings a search reads.
RAREST = 3
#: Tasks (and so files) that share a gram's postings.
SPREAD = 8
_GRAMS = f"(?s)(?=(.{{{GRAM}}}))"


def grams_of(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(_GRAMS), 1))


def write_gram_index(df: DataFrame, id_col: str, col: str, root: str, fold: Callable[[Column], Column] = lower_ascii) -> None:
    """Write the postings and then the grams' counts. ``fold`` is ``lower_ascii`` for
    ``search_like`` and Spark's ``lower`` for ``search_contains``: each as its filter compares."""
    base = root.rstrip("/")
    each = df.select(F.col(id_col).alias("id"), F.explode(grams_of(fold(F.col(col)))).alias("gram"))
    # Placed by hash: a range would first extract all grams once more, for its sample.
    placed = each.repartition("gram", F.pmod(F.xxhash64("id"), F.lit(SPREAD))).sortWithinPartitions("gram", "id")
    placed.write.mode("overwrite").option("parquet.bloom.filter.enabled#gram", "true").parquet(f"{base}/postings")
    postings = df.sparkSession.read.schema(each.schema).parquet(f"{base}/postings")
    counts = postings.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    counts.repartitionByRange("gram").sortWithinPartitions("gram").write.mode("overwrite").parquet(f"{base}/counts")


def _grams(pieces: list[str]) -> list[str]:
    return sorted({p[i:i + GRAM] for p in pieces for i in range(len(p) - GRAM + 1)})


def _folded(df: DataFrame, value: str, fold: Callable[[Column], Column]) -> str:
    return df.sparkSession.range(1).select(fold(F.lit(value))).first()[0]


def candidates(df: DataFrame, id_col: str, root: str, grams: list[str]) -> DataFrame:
    """The rows of ``df`` that have the rarest of ``grams``."""
    base, spark = root.rstrip("/"), df.sparkSession
    counts = spark.read.schema("gram string, n bigint").parquet(f"{base}/counts")
    # At most one row per gram of the pattern.
    found = sorted((r.n, r.gram) for r in counts.filter(F.col("gram").isin(grams)).collect())
    if len(found) < len(grams):
        return df.filter(F.lit(False))
    rare = [g for _, g in found[:RAREST]]
    kind = df.schema[id_col].dataType.simpleString()
    postings = spark.read.schema(f"id {kind}, gram string").parquet(f"{base}/postings").filter(F.col("gram").isin(rare))
    ids = postings.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(rare))
    return df.join(ids.select(F.col("id").alias(id_col)), id_col, "left_semi")


def search_like(df: DataFrame, id_col: str, col: str, value: str | None, root: str) -> DataFrame:
    """As ``like_filter``: ``%`` and ``_`` in the value are wildcards."""
    grams = _grams(re.split("[%_]", _folded(df, value, lower_ascii))) if value else []
    return like_filter(candidates(df, id_col, root, grams) if grams else df, col, value)


def search_contains(df: DataFrame, id_col: str, col: str, value: str, root: str) -> DataFrame:
    """As ``contains_filter``: every character stands for itself."""
    grams = _grams([_folded(df, value, F.lower)])
    return contains_filter(candidates(df, id_col, root, grams) if grams else df, col, value)
