"""Exact deep pages by a rank index.

A snapshot is range-partitioned by the list's order, so every slice holds consecutive
rows, and a small table keeps each slice's row count and the rows before it. A page
looks its offset up there and reads only the slices that hold it; neither the table nor the
rows before the page are read, whatever the offset. Nulls and ties are placed as the
order places them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shipfold.operators.paging import check_page
from shipfold.profiles import DEFAULT_PAGE_SIZE

SLICE = "slice"


def _descending(order_cols: Sequence[str]) -> list[Column]:
    return [F.col(c).desc() for c in order_cols]


def write_page_index(df: DataFrame, order_cols: Sequence[str], root: str, slices: int) -> None:
    """Write ``df`` as slices in descending order of ``order_cols`` (the last one unique),
    then the index of their counts; readers look for the index."""
    base = root.rstrip("/")
    order = _descending(order_cols)
    ordered = df.repartitionByRange(slices, *order).sortWithinPartitions(*order)
    ordered.withColumn(SLICE, F.spark_partition_id()).write.mode("overwrite").partitionBy(SLICE).parquet(f"{base}/rows")
    # An empty list leaves no file among the rows to take the schema from.
    df.limit(0).write.mode("overwrite").parquet(f"{base}/schema")
    counts = _rows(df.sparkSession, base).groupBy(SLICE).agg(F.count(F.lit(1)).alias("n"))
    # One row per slice.
    before = Window.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    index = counts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    index.coalesce(1).write.mode("overwrite").parquet(f"{base}/index")


def _rows(spark: SparkSession, base: str) -> DataFrame:
    schema = spark.read.parquet(f"{base}/schema").schema
    return spark.read.schema(schema.add(SLICE, "integer")).parquet(f"{base}/rows")


def slices_of(spark: SparkSession, root: str, offset: int, size: int) -> list[tuple[int, int]]:
    """(slice, rows before it) of the slices that hold rows ``offset`` to ``offset + size``:
    at most ``size`` of them."""
    index = spark.read.parquet(f"{root.rstrip('/')}/index")
    hit = index.filter((F.col("start") < offset + size) & (F.col("start") + F.col("n") > offset))
    return [(r[SLICE], r["start"]) for r in hit.orderBy(SLICE).limit(size).collect()]


def seek_page(spark: SparkSession, root: str, order_cols: Sequence[str], page: int = 1,
              page_size: int = DEFAULT_PAGE_SIZE) -> DataFrame:
    """The page's rows, in order; past the end none."""
    check_page(page, page_size)
    offset = (page - 1) * page_size
    hit = slices_of(spark, root, offset, page_size)
    rows = _rows(spark, root.rstrip("/")).filter(F.col(SLICE).isin([s for s, _ in hit])).drop(SLICE)
    skip = offset - hit[0][1] if hit else 0
    ordered = rows.orderBy(*_descending(order_cols))
    return (ordered.offset(skip) if skip else ordered).limit(page_size)
