"""Exact top-k of a column with any number of values, without a shuffle of its values (A4).

1. A mergeable frequent-items sketch proposes at most ``CANDIDATES`` values.
2. One pass counts these exactly and all other rows by a hash bucket: at most
   ``BUCKETS`` more groups, so partial counts are small whatever the column holds.
3. No other value can have more rows than its bucket. A bucket below the k-th
   candidate's count is thereby settled; the values of the others are counted in full.

So the sketch's error never touches the result: a poor proposal only leaves more buckets
to count. On a flat column that is all of them, which is the plain count. Nulls are not
counted; ties are broken by the value, ascending; an empty column gives no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shipfold.operators.aggregates import TOP_K
from shipfold.session import scratch_dir

CANDIDATES = 256
TRACKED = 8192
BUCKETS = 1 << 16


def candidate_counts(rows: DataFrame, tracked: int, buckets: int) -> DataFrame:
    """``label, bucket, cnt``: a candidate's count has a label, the others' count a bucket."""
    found = rows.agg(F.expr(f"approx_top_k(v, {min(CANDIDATES, tracked)}, {tracked})").alias("t")).select(F.explode("t.item").alias("v"))
    # At most CANDIDATES numbers; a value that shares a candidate's hash is counted as one, exactly.
    hashes = [r[0] for r in found.select(F.xxhash64("v")).collect()]
    h = F.xxhash64("v")
    near = h.isin(hashes) if hashes else F.lit(False)
    return (rows.groupBy(F.when(near, F.col("v")).alias("label"), F.when(~near, F.pmod(h, F.lit(buckets)).cast("int")).alias("bucket"))
            .agg(F.count(F.lit(1)).alias("cnt")))


def exact_top_k(df: DataFrame, col: str, k: int = TOP_K, label: str = "label", tracked: int = TRACKED,
                buckets: int = BUCKETS) -> DataFrame:
    """``label, cnt`` of the k most frequent values: as ``aggregates.top_k`` gives them."""
    spark = df.sparkSession
    rows = df.select(F.col(col).alias("v")).filter(F.col("v").isNotNull())
    path = scratch_dir(spark, "topk")
    candidate_counts(rows, tracked, buckets).write.parquet(path)
    counted = spark.read.parquet(path)
    order = [F.col("cnt").desc(), F.col("label").asc()]
    sure = counted.filter(F.col("bucket").isNull()).select("label", "cnt").orderBy(*order).limit(k)
    last = sure.agg(F.count(F.lit(1)), F.min("cnt")).first()
    floor = last[1] if last[0] == k else 1
    # At most ``buckets`` numbers, so a proven bound for the broadcast. A tie counts as open.
    unsettled = counted.filter(F.col("bucket").isNotNull() & (F.col("cnt") >= floor)).select("bucket")
    names = counted.filter(F.col("bucket").isNull()).select(F.xxhash64("label").alias("h")).distinct()
    rest = (rows.withColumn("bucket", F.pmod(F.xxhash64("v"), F.lit(buckets)).cast("int"))
            .join(F.broadcast(unsettled), "bucket", "left_semi")
            .withColumn("h", F.xxhash64("v")).join(F.broadcast(names), "h", "left_anti"))
    counts = rest.groupBy(F.col("v").alias("label")).agg(F.count(F.lit(1)).alias("cnt")).orderBy(*order).limit(k)
    return sure.unionByName(counts).orderBy(*order).limit(k).select(F.col("label").alias(label), "cnt")
