"""The change-log fold as a Structured Streaming job.

The fold state per key is a set of min/max aggregates, so Spark's streaming
aggregation keeps it incrementally in the state store (checkpointed, so a
lost executor or a restarted job resumes exactly). In ``update`` mode each
micro-batch emits the merged state of the keys it touched; ``foreachBatch``
turns that into current rows and writes them as version ``batch_id``
(overwrite, so a replayed batch writes the same files again). The current
table is the newest version of each key.

Batches may arrive in any order and overlap: min/max merges are order-free,
so any split of the log gives the one-shot fold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shipfold.operators.fold import finish, state_aggregates
from shipfold.operators.tables import newest_partition


def start_stream_fold(changes_stream: DataFrame, columns: Sequence[str], sink_dir: str,
                      checkpoint_dir: str, milestone: bool = False,
                      available_now: bool = True) -> StreamingQuery:
    """Start folding a streaming change log into versioned current rows."""
    state = changes_stream.groupBy("key").agg(*state_aggregates(columns))
    cols = list(columns)

    def write_version(batch: DataFrame, batch_id: int) -> None:
        rows = finish(batch, cols, milestone).withColumn("version", F.lit(batch_id).cast("bigint"))
        rows.write.mode("overwrite").parquet(f"{sink_dir.rstrip('/')}/version={batch_id}")

    writer = (state.writeStream.outputMode("update").foreachBatch(write_version)
              .option("checkpointLocation", checkpoint_dir))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def _newest(versions: DataFrame, columns: Sequence[str]) -> DataFrame:
    cols = (*columns, "row_seq", "last_updated")
    payload = F.struct(*[F.col(c) for c in cols])
    latest = versions.groupBy("key").agg(F.max_by(payload, F.col("version")).alias("_r"))
    return latest.select("key", *[F.col(f"_r.{c}").alias(c) for c in cols])


def _base_version(spark: SparkSession, sink_dir: str):
    return newest_partition(spark, f"{sink_dir.rstrip('/')}/_base", "at")


def read_current(spark: SparkSession, sink_dir: str, columns: Sequence[str]) -> DataFrame:
    """Newest version of every key: one aggregation with a partial step.

    After a compaction only the compacted base and the versions written since
    are read (the version filter prunes the older folders).
    """
    base = sink_dir.rstrip("/")
    at = _base_version(spark, sink_dir)
    versions = spark.read.parquet(base)
    if at is None:
        return _newest(versions, columns)
    compacted = spark.read.parquet(f"{base}/_base/at={int(at)}").withColumn("version", F.lit(int(at)).cast("bigint"))
    recent = versions.filter(F.col("version") > F.lit(int(at)))
    return _newest(compacted.unionByName(recent.select(*compacted.columns)), columns)


def compact(spark: SparkSession, sink_dir: str, columns: Sequence[str]) -> int | None:
    """Fold all versions into one base snapshot at the newest version, so
    later reads skip the older version folders. Returns that version."""
    base = sink_dir.rstrip("/")
    # The newest version folder, from the listing (``_base`` is hidden from it).
    latest = newest_partition(spark, base, "version")
    if latest is None:
        return None
    # Only versions up to ``latest`` enter the base; a stream may keep writing.
    snap = _newest_upto(spark, sink_dir, columns, int(latest))
    snap.write.mode("overwrite").parquet(f"{base}/_base/at={int(latest)}")
    return int(latest)


def _newest_upto(spark: SparkSession, sink_dir: str, columns: Sequence[str], upto: int) -> DataFrame:
    base = sink_dir.rstrip("/")
    at = _base_version(spark, sink_dir)
    versions = spark.read.parquet(base).filter(F.col("version") <= F.lit(upto))
    if at is not None:
        compacted = spark.read.parquet(f"{base}/_base/at={int(at)}").withColumn(
            "version", F.lit(int(at)).cast("bigint"))
        versions = compacted.unionByName(
            versions.filter(F.col("version") > F.lit(int(at))).select(*compacted.columns))
    return _newest(versions, columns)
