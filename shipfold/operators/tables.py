"""Table maintenance: reset and reseed, seed-if-empty, column models (S12,
S13, P9, A11)."""

from __future__ import annotations

import re
import uuid
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shipfold.operators.aggregates import table_counts


def seed_if_empty(current: DataFrame, seed: DataFrame, force: bool = False) -> DataFrame:
    """The seed rows to write: all of them when the table is empty (or
    ``force``), none otherwise (S13). The emptiness check reads one row."""
    if force or current.isEmpty():
        return seed
    return seed.limit(0)


def reset_tables(spark: SparkSession, root: str, current: Mapping[str, DataFrame],
                 seeds: Mapping[str, DataFrame]) -> DataFrame:
    """Count, clear and reseed tables stored under ``root``.

    Each table is rewritten with ``mode('overwrite')`` from its seed frame
    (tables without a seed are written empty). Returns ``(table_name,
    cleared, reseeded)``, the reseeded counts read back from what was
    written.
    """
    # Counted before anything is written: the tables may be those under ``root``.
    cleared = spark.createDataFrame([tuple(r) for r in table_counts(current).collect()],
                                    "table_name string, cleared long")  # a row a table
    written = {}
    for name, df in current.items():
        seed = seeds.get(name, df.limit(0))
        path = f"{root.rstrip('/')}/{name}"
        # Written beside the old version first, as the seed may read the table itself.
        new = f"{root.rstrip('/')}/_reset/{name}-{uuid.uuid4().hex[:12]}"
        seed.write.parquet(new)
        spark.read.schema(seed.schema).parquet(new).write.mode("overwrite").parquet(path)
        written[name] = spark.read.schema(seed.schema).parquet(path)
    reseeded = table_counts(written).withColumnRenamed("row_count", "reseeded")
    return cleared.join(reseeded, "table_name")


def column_options(spark: SparkSession, grid: Sequence[tuple[str, str, str, str | None]],
                   vocab: DataFrame) -> DataFrame:
    """Grid column model joined with its vocabularies by options key.

    ``vocab(options_key, pos, value)``; options are ordered by ``pos``. The
    column model is fixed metadata (tens of rows); each vocabulary is one
    list of choices, collected per options key after a partial aggregate.
    """
    model = spark.createDataFrame(
        [(i, c, label, kind, key) for i, (c, label, kind, key) in enumerate(grid)],
        "position int, column string, label string, filter_kind string, options_key string")
    opts = vocab.groupBy("options_key").agg(
        F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("_o"))
    opts = opts.select("options_key", F.transform("_o", lambda e: e["value"]).alias("options"))
    # Both sides are small; AQE picks the join from their measured sizes.
    return model.join(opts, "options_key", "left").select(
        "position", "column", "label", "filter_kind", "options_key",
        F.coalesce(F.size("options"), F.lit(0)).alias("n_options"),
        F.array_join("options", "|").alias("options"))


# -- S11: change-log appends and snapshot publication -------------------------
#
# Writes never update in place. A change batch is appended as its own
# partition; only a caller that owns its batch id may write it again after a
# failure. A snapshot is written to a new version folder first; only then is
# the version recorded in a small commit table. Readers take the newest
# committed version, so they see either the old or the new snapshot whole.


def append_changes(changes: DataFrame, log_root: str, batch_id: int, replace: bool = True) -> None:
    """Append one batch of changes to the log. With ``replace`` the same batch id
    replaces itself (a retried job that owns its id); without it a batch that is
    there fails the call, so that two writers never lose one another's."""
    mode = "overwrite" if replace else "errorifexists"
    changes.write.mode(mode).parquet(f"{log_root.rstrip('/')}/batch={int(batch_id)}")


def read_changes(spark: SparkSession, log_root: str) -> DataFrame:
    return spark.read.parquet(log_root)


def newest_partition(spark: SparkSession, root: str, name: str) -> int | None:
    """Largest ``N`` of the partition folders ``name=N`` under ``root``, or
    None. Taken from the file listing a scan makes anyway; no row is read, so
    the cost does not grow with the table's rows."""
    try:
        files = spark.read.parquet(root).inputFiles()
    except AnalysisException:
        return None
    folder = re.compile(rf"/{re.escape(name)}=(\d+)/")
    return max((int(m.group(1)) for m in map(folder.search, files) if m), default=None)


def publish_snapshot(spark: SparkSession, current: DataFrame, root: str, version: int,
                     cluster_key: str | None = None, files: int | None = None) -> None:
    """Write-new-then-swap: data first, then the commit record.

    With ``cluster_key`` the snapshot is range-partitioned and sorted by that
    key, so each file and row group covers a narrow key range and a point
    lookup skips the others through Parquet min/max statistics (F8); a Bloom
    filter per row group skips the one that the key would be in but is not.
    """
    base = root.rstrip("/")
    writer = current.write
    if cluster_key:
        n = files or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
        writer = current.repartitionByRange(n, cluster_key).sortWithinPartitions(cluster_key).write
        writer = writer.option(f"parquet.bloom.filter.enabled#{cluster_key}", "true")
    writer.mode("overwrite").parquet(f"{base}/data/version={int(version)}")
    commit_version(spark, base, version)


def commit_version(spark: SparkSession, root: str, version: int) -> None:
    spark.createDataFrame([(int(version),)], "version long").write.mode("append").parquet(
        f"{root.rstrip('/')}/commits")


def read_snapshot(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The newest committed snapshot, or the committed ``version``."""
    newest = committed_version(spark, root)
    if newest is None or (version is not None and not _commits(spark, root).filter(F.col("version") == version).take(1)):
        raise FileNotFoundError(f"no committed snapshot{'' if version is None else f' {version}'} under {root}")
    version = newest if version is None else version
    return spark.read.parquet(f"{root.rstrip('/')}/data/version={version}")


def _commits(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema("version long").parquet(f"{root.rstrip('/')}/commits")


def committed_version(spark: SparkSession, root: str) -> int | None:
    """Version of the newest committed snapshot, None before the first."""
    try:
        version = _commits(spark, root).agg(F.max("version")).first()[0]
    except AnalysisException:
        return None
    return None if version is None else int(version)
