"""Session construction and shared scratch space."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job relies on. AQE re-plans joins and coalesces small shuffle
# partitions at run time; the session zone is fixed so NTZ maths never depends
# on where the driver runs.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Whole pages and workbooks travel through Arrow: keep input batches small,
    # in rows and in bytes (a batch closes at whichever limit comes first).
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(64 * 1024 * 1024),
    "spark.ui.enabled": "false",
    # Fold state is one row per key (as large as the table): keep it in RocksDB,
    # off the JVM heap, with incremental checkpoints.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


# Settings for the target scale (hundreds of TB on a large cluster). The
# engine never forces them on a given session; ``apply_scale_defaults`` sets
# only those the session leaves unset.
SCALE_DEFAULTS = {
    # Many initial shuffle partitions; AQE coalesces them to ~256 MB each, so
    # no reduce task has to spill more than its share.
    "spark.sql.shuffle.partitions": "20000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 * 1024 * 1024),
    "spark.sql.files.maxPartitionBytes": str(256 * 1024 * 1024),
    # Hot keys (a third of all rows) are split at run time.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "3",
    # Runtime broadcast only for sides measured under 64 MB.
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
    # Whole pages and workbooks travel through Arrow: keep batches small, in
    # rows and in bytes.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(64 * 1024 * 1024),
}


def apply_scale_defaults(spark: SparkSession) -> dict:
    """Set the scale settings the session does not already set; returns them."""
    applied = {}
    for k, v in SCALE_DEFAULTS.items():
        try:
            if spark.conf.get(k, None) is None:
                spark.conf.set(k, v)
                applied[k] = v
        except Exception:  # noqa: BLE001 - a static conf on this session
            continue
    return applied


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "shipfold", extra: dict | None = None) -> SparkSession:
    """Local session for tests and benchmarks; on a cluster use the given one."""
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(_DEFAULTS)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf["spark.driver.memory"] = "16g"
    conf.update(extra or {})
    if "spark.checkpoint.dir" not in conf:
        # Tests and benchmarks only: a cluster names its shared folder itself.
        conf["spark.checkpoint.dir"] = tempfile.mkdtemp(prefix="shipfold-ckpt-")
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def _context(spark: SparkSession):
    try:
        return spark.sparkContext
    except Exception:  # noqa: BLE001 - sessions without a context (Spark Connect)
        return None


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, creating a local one only if unset.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used as
    is. Only a local session without it (tests, benchmarks) gets its own.
    """
    sc = _context(spark)
    if sc is not None:
        current = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    else:
        current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        master = sc.master if sc is not None else spark.conf.get("spark.master", "")
        if not re.match(r"local(\[|$)", master or ""):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        current = tempfile.mkdtemp(prefix="shipfold-ckpt-")
    if sc is not None and sc.getCheckpointDir() is None:
        sc.setCheckpointDir(current)
    return current


def default_parallelism(spark: SparkSession) -> int:
    sc = _context(spark)
    if sc is not None:
        return sc.defaultParallelism
    return int(spark.conf.get("spark.sql.shuffle.partitions", "8"))


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder for written tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def partition_count(df) -> int | None:
    """Partition count of a DataFrame when the session exposes RDDs."""
    try:
        return df.rdd.getNumPartitions()
    except Exception:  # noqa: BLE001 - Spark Connect
        return None
