"""Table maintenance, column model and streaming queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shipfold.operators import fold as FO
from shipfold.operators import normalise as N
from shipfold.operators import tables as TB
from shipfold.plans.queries_fold import _DISP_SQL
from shipfold.plans.registry import register
from shipfold.plans.tables import (EVENT_COLUMNS, MILESTONES_SQL, SHIPMENTS_SQL, events_changes,
                                   fold_sql, milestones_of, shipments_of, table, typed_events_fold)
from shipfold.profiles import IMPORT_CONFIRM_GRID, UPDATE_TYPE_COLUMNS
from shipfold.session import default_parallelism, scratch_dir
from shipfold.streaming.fold_stream import read_current, start_stream_fold
from shipfold.streaming.outcome_stream import OUTCOMES, start_outcome_stream

# Vocabularies derived from the data: options key -> (table, column).
_VOCAB_SOURCES = {
    "STATUS": ("orders", "o_orderstatus"),
    "ABI_STATUS": ("orders", "o_orderpriority"),
    "AIRLINES": ("customer", "c_mktsegment"),
    "WT": ("lineitem", "l_linestatus"),
    "SC_JOB_STATUS": ("lineitem", "l_returnflag"),
}


def _model_sql() -> str:
    rows = ", ".join(
        f"({i}, '{c}', '{label}', '{kind}', {('NULL' if key is None else repr(key))})"
        for i, (c, label, kind, key) in enumerate(IMPORT_CONFIRM_GRID))
    vocab = " UNION ALL ".join(
        f"SELECT DISTINCT '{k}' AS options_key, {col} AS value FROM {t}"
        for k, (t, col) in _VOCAB_SOURCES.items())
    return f"""
WITH model(position, "column", label, filter_kind, options_key) AS (VALUES {rows}),
v AS ({vocab}),
o AS (SELECT options_key, COUNT(*) AS n, string_agg(value, '|' ORDER BY value) AS options
      FROM v GROUP BY options_key)
SELECT position, "column", label, filter_kind, model.options_key,
       CAST(COALESCE(n, 0) AS INTEGER) AS n_options, options
FROM model LEFT JOIN o USING (options_key)"""


@register("column_options", sql=_model_sql())
def column_options(spark, sf_dir):
    """Each grid column with its ordered option list, the vocabularies
    being the distinct values of categorical columns."""
    parts = [table(spark, sf_dir, t).select(F.col(c).alias("value")).distinct()
             .select(F.lit(k).alias("options_key"), "value")
             for k, (t, c) in _VOCAB_SOURCES.items()]
    vocab = reduce(DataFrame.unionByName, parts).withColumn("pos", F.col("value"))
    return TB.column_options(spark, IMPORT_CONFIRM_GRID, vocab.select("options_key", "pos", "value"))


@register("update_type_map", sql="""
SELECT CAST(o_orderkey AS VARCHAR) AS mawb,
       CASE o_orderstatus WHEN 'F' THEN 'Flight(Last Leg)' WHEN 'O' THEN 'ETA' ELSE 'Warehouse' END AS update_type,
       CASE o_orderstatus WHEN 'F' THEN 'flight_no' WHEN 'O' THEN 'eta' END AS target_column,
       o_orderstatus IN ('F', 'O') AS accepted
FROM orders""")
def update_type_map(spark, sf_dir):
    """Update type -> column; refused types have no column."""
    o = table(spark, sf_dir, "orders")
    ut = (F.when(F.col("o_orderstatus") == "F", F.lit("Flight(Last Leg)"))
          .when(F.col("o_orderstatus") == "O", F.lit("ETA")).otherwise(F.lit("Warehouse")))
    target = N.update_type_column(ut, UPDATE_TYPE_COLUMNS)
    return o.select(F.col("o_orderkey").cast("string").alias("mawb"), ut.alias("update_type"),
                    target.alias("target_column"), target.isNotNull().alias("accepted"))


@register("reset_report", sql=f"""WITH {SHIPMENTS_SQL}, {MILESTONES_SQL}
SELECT 'import_confirm' AS table_name, (SELECT COUNT(*) FROM shipments) AS cleared,
       (SELECT COUNT(*) FROM shipments WHERE pod = '1-URGENT') AS reseeded
UNION ALL SELECT 'pickup_report', (SELECT COUNT(*) FROM lineitem), 0
UNION ALL SELECT 'atd_ata', (SELECT COUNT(*) FROM milestones),
       (SELECT COUNT(*) FROM milestones WHERE ata IS NOT NULL)""")
def reset_report(spark, sf_dir):
    """Count, clear and reseed the three tables; the seed frames are the
    urgent shipments and the arrived milestones."""
    ship, miles = shipments_of(spark, sf_dir), milestones_of(spark, sf_dir)
    current = {"import_confirm": ship, "pickup_report": table(spark, sf_dir, "lineitem"),
               "atd_ata": miles}
    seeds = {"import_confirm": ship.filter(F.col("pod") == "1-URGENT"),
             "atd_ata": miles.filter(F.col("ata").isNotNull())}
    # The tables as stored under the root that is reset.
    root = scratch_dir(spark, "reset")
    for name, df in current.items():
        df.write.parquet(f"{root}/{name}")
    current = {name: spark.read.parquet(f"{root}/{name}") for name in current}
    return TB.reset_tables(spark, root, current, seeds)


@register("seed_if_empty", sql=f"""WITH {MILESTONES_SQL}
SELECT 'import_confirm' AS table_name, CAST(0 AS BIGINT) AS seeded
UNION ALL SELECT 'atd_ata', COUNT(*) FROM milestones""")
def seed_if_empty(spark, sf_dir):
    """Seed only an empty table; the shipment list has rows, the
    not-yet-arrived-by-2100 milestone table is empty."""
    ship, miles = shipments_of(spark, sf_dir), milestones_of(spark, sf_dir)
    a = TB.seed_if_empty(ship, ship).agg(F.count(F.lit(1)).alias("seeded"))
    b = TB.seed_if_empty(miles.filter(F.col("ata") > "2100"), miles).agg(F.count(F.lit(1)).alias("seeded"))
    return (a.select(F.lit("import_confirm").alias("table_name"), "seeded")
            .unionByName(b.select(F.lit("atd_ata").alias("table_name"), "seeded")))


STREAM_BATCHES = 4


@register("stream_fold", sql=fold_sql())
def stream_fold(spark, sf_dir):
    """The events change log replayed as a file stream (several
    micro-batches), folded by a stateful streaming aggregation; the result
    equals the one-shot fold."""
    src = scratch_dir(spark, "stream_src")
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")
    # Files cut by event_id range, as a log lands; about STREAM_BATCHES
    # micro-batches take them in turn.
    n_files = max(STREAM_BATCHES, default_parallelism(spark))
    ev.repartitionByRange(n_files, "event_id").write.mode("overwrite").parquet(src)
    per_trigger = -(-n_files // STREAM_BATCHES)
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", per_trigger).parquet(src)
    sink, ckpt = scratch_dir(spark, "stream_sink"), scratch_dir(spark, "stream_ckpt")
    q = start_stream_fold(events_changes(stream), EVENT_COLUMNS, sink, ckpt)
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return typed_events_fold(read_current(spark, sink, EVENT_COLUMNS))


@register("stream_outcomes", sql=_DISP_SQL)
def stream_outcomes(spark, sf_dir):
    """T1 + J1: the events change log replayed as a file stream in ``seq`` order; each
    change's outcome is appended once, from keyed state."""
    src = scratch_dir(spark, "stream_src")
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")
    # One folder per stretch of the log, in order: a batch takes the files of one.
    cuts = ev.agg(F.min("event_id"), F.max("event_id")).first()
    step = F.floor((F.col("event_id") - F.lit(cuts[0] or 0)) * STREAM_BATCHES / F.lit((cuts[1] or 0) - (cuts[0] or 0) + 1))
    sink, ckpt = scratch_dir(spark, "stream_sink"), scratch_dir(spark, "stream_ckpt")
    for k in range(STREAM_BATCHES):
        ev.filter(step == k).write.parquet(f"{src}/part={k}")
        stream = spark.readStream.schema(ev.schema).parquet(f"{src}/part=*")
        q = start_outcome_stream(events_changes(stream), sink, ckpt)  # goes on from its checkpoint
        q.awaitTermination()
        if q.exception() is not None:
            raise RuntimeError(str(q.exception()))
    out = spark.read.schema(OUTCOMES).parquet(sink)
    return out.select(F.col("key").cast("bigint").alias("user_id"), F.col("seq").alias("event_id"), "kind", "disposition")


@register("snapshot_publish", sql=fold_sql())
def snapshot_publish(spark, sf_dir):
    """The log appended in two batches, each published as a snapshot of fold
    state (write-new-then-swap): version 2 is version 1's state and batch 2 alone.
    The newest committed version is read back."""
    root = scratch_dir(spark, "store")
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")
    cutoff = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    TB.append_changes(events_changes(ev.filter(F.col("ts") < cutoff)), f"{root}/log", 1)
    TB.publish_snapshot(spark, published_state(spark, root), f"{root}/snap", 1, cluster_key="key")
    TB.append_changes(events_changes(ev.filter(F.col("ts") >= cutoff)), f"{root}/log", 2)
    TB.publish_snapshot(spark, published_state(spark, root), f"{root}/snap", 2, cluster_key="key")
    return typed_events_fold(FO.finish(TB.read_snapshot(spark, f"{root}/snap"), EVENT_COLUMNS))


def published_state(spark, root):
    """Fold state of the newest snapshot and the batches after it."""
    done = TB.committed_version(spark, f"{root}/snap")
    tail = TB.read_changes(spark, f"{root}/log").filter(F.col("batch") > (done or 0)).drop("batch")
    return FO.fold_state(tail, EVENT_COLUMNS, TB.read_snapshot(spark, f"{root}/snap") if done else None)
