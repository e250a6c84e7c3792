"""Facet counts kept up to date by the rows that a batch touches.

The fold state of the keys that a batch touches is written as one version, in
``BUCKETS`` folders by a hash of the key; nothing else of the table is written or read. A
batch reads the older versions of the touched buckets only, and of these the touched
keys. Each touched key's old row gives -1 and its new row +1 to the facets they fall
into; the sums are added to the counts of the version before. A version counts once its
commit record is there, so a batch that failed half-way is simply run again.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shipfold.functions.text import blank_default
from shipfold.operators.fold import finish, fold_state
from shipfold.operators.tables import commit_version, committed_version

BUCKETS = 64


def _bucket() -> Column:
    return F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).cast("int")


def contributions(rows: DataFrame, labelled: Mapping[str, tuple[str, str]], top: Mapping[str, str], sign: int = 1) -> DataFrame:
    """``facet, label, cnt``: what the rows add to (or take from) each facet's counts."""
    cells = [F.struct(F.lit("total").alias("facet"), F.lit(None).cast("string").alias("label"))]
    cells += [F.struct(F.lit(n).alias("facet"), blank_default(c, d).alias("label")) for n, (c, d) in labelled.items()]
    cells += [F.struct(F.lit(n).alias("facet"), F.col(c).alias("label")) for n, c in top.items()]
    each = rows.select(F.explode(F.array(*cells)).alias("c")).select("c.facet", "c.label")
    counted = each.filter((F.col("facet") == "total") | F.col("label").isNotNull())
    return counted.groupBy("facet", "label").agg((F.count(F.lit(1)) * sign).alias("cnt"))


def _summed(parts: Sequence[DataFrame]) -> DataFrame:
    return (reduce(DataFrame.unionByName, parts).groupBy("facet", "label").agg(F.sum("cnt").alias("cnt"))
            .filter(F.col("cnt") != 0))


def old_states(spark: SparkSession, root: str, before: int, buckets: Sequence[int], keys: DataFrame) -> DataFrame:
    """The newest states of ``keys`` among the versions up to ``before``, from their buckets alone."""
    path = f"{root.rstrip('/')}/state"
    states = spark.read.parquet(path).filter((F.col("version") <= before) & F.col("bucket").isin(list(buckets)))
    names = [c for c in states.columns if c not in ("key", "version", "bucket")]
    newest = (states.join(keys, "key", "left_semi").groupBy("key")
              .agg(F.max_by(F.struct(*names), F.col("version")).alias("s")))
    return newest.select("key", *[F.col("s")[c].alias(c) for c in names])


def publish_batch(changes: DataFrame, root: str, version: int, columns: Sequence[str],
                  labelled: Mapping[str, tuple[str, str]], top: Mapping[str, str]) -> None:
    """Fold a batch into the touched keys' states and the facets' counts. Versions count from 1."""
    spark, base = changes.sparkSession, root.rstrip("/")
    before = committed_version(spark, base) or 0
    if version != before + 1:
        raise ValueError(f"version {version} does not follow {before}")
    old = None
    if before:
        keys = changes.select("key").distinct()
        # At most BUCKETS numbers.
        touched = [r[0] for r in keys.select(_bucket().alias("b")).distinct().collect()]
        old = old_states(spark, base, before, touched, keys)
    state = fold_state(changes, columns, old)
    # One bucket's rows meet in few tasks, and so in few files; large buckets are split again.
    placed = state.withColumn("bucket", _bucket()).hint("rebalance", "bucket")
    placed.write.mode("overwrite").partitionBy("bucket").parquet(f"{base}/state/version={version}")
    new = spark.read.schema(state.schema).parquet(f"{base}/state/version={version}")
    parts = [contributions(finish(new, columns), labelled, top)]
    if before:
        parts.append(contributions(finish(old, columns), labelled, top, -1))
        parts.append(spark.read.parquet(f"{base}/counts/version={before}"))
    _summed(parts).write.mode("overwrite").parquet(f"{base}/counts/version={version}")
    commit_version(spark, base, version)


def read_report(spark: SparkSession, root: str, top: Mapping[str, str], k: int) -> DataFrame:
    """The facet report (``facet, label, cnt``) of the newest version, from the counts alone."""
    version = committed_version(spark, root)
    if version is None:
        raise FileNotFoundError(f"no committed facets under {root}")
    counts = spark.read.parquet(f"{root.rstrip('/')}/counts/version={version}")
    total = counts.filter(F.col("facet") == "total").agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("cnt"))
    parts = [total.select(F.lit("total").alias("facet"), F.lit(None).cast("string").alias("label"), "cnt"),
             counts.filter(~F.col("facet").isin("total", *top))]
    parts += [counts.filter(F.col("facet") == n).orderBy(F.col("cnt").desc(), "label").limit(k) for n in top]
    return reduce(DataFrame.unionByName, parts)

