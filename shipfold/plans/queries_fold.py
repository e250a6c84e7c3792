"""Queries over the change log (events bound as changes): folds,
dispositions, tallies, cleaning and payload helpers."""

from __future__ import annotations

from pyspark.sql import functions as F

from shipfold.functions import text as T
from shipfold.operators import aggregates as A
from shipfold.operators import fold as FO
from shipfold.operators import normalise as N
from shipfold.operators import paging as P
from shipfold.plans.registry import register
from shipfold.plans.tables import (EVENT_COLUMNS, changes_sql, events_changes_of,
                                   fold_sql, table, typed_events_fold)


def _fold(spark, sf_dir, types=None):
    return typed_events_fold(FO.fold(events_changes_of(spark, sf_dir, types), EVENT_COLUMNS))


@register("fold_upsert", sql=fold_sql(("purchase",)))
def fold_upsert(spark, sf_dir):
    """A10 on upload upserts only: each sets only the columns it carries."""
    return _fold(spark, sf_dir, ("purchase",))


@register("fold_bulk", sql=fold_sql(("purchase", "error")))
def fold_bulk(spark, sf_dir):
    """A10 with bulk upserts whose present NULL overwrites."""
    return _fold(spark, sf_dir, ("purchase", "error"))


@register("fold_patch", sql=fold_sql(("signup", "click", "view")))
def fold_patch(spark, sf_dir):
    """A10 with replaces and patches; patches before the first insert do
    nothing."""
    return _fold(spark, sf_dir, ("signup", "click", "view"))


@register("fold_all", sql=fold_sql())
def fold_all(spark, sf_dir):
    """A10 over the whole log: replace, upload and bulk upserts, patches."""
    return _fold(spark, sf_dir)


_DISP_SQL = f"""WITH {changes_sql()},
k AS (SELECT key, MIN(seq) FILTER (WHERE kind IN ('replace', 'upsert')) AS first_insert
      FROM ch2 GROUP BY key)
SELECT CAST(ch2.key AS BIGINT) AS user_id, seq AS event_id, kind,
       CASE WHEN kind <> 'patch' THEN 'upserted'
            WHEN NOT applicable THEN 'skipped'
            WHEN first_insert IS NOT NULL AND seq > first_insert THEN 'ok'
            ELSE 'not_found' END AS disposition
FROM ch2 LEFT JOIN k USING (key)"""


@register("patch_disposition", sql=_DISP_SQL)
def patch_disposition(spark, sf_dir):
    """Every change's outcome; a patch before its key's first insert is
    not_found."""
    d = FO.dispositions(events_changes_of(spark, sf_dir))
    return d.select(F.col("key").cast("bigint").alias("user_id"),
                    F.col("seq").alias("event_id"), "kind", "disposition")


@register("disposition_tally", sql=f"""WITH d AS ({_DISP_SQL})
SELECT disposition, COUNT(*) AS cnt FROM d GROUP BY disposition""")
def disposition_tally(spark, sf_dir):
    """Count per outcome."""
    return A.disposition_tally(FO.dispositions(events_changes_of(spark, sf_dir)))


@register("not_found_keys", sql="""
SELECT c_custkey AS user_id FROM customer
WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE event_type IN ('signup', 'purchase', 'error'))""")
def not_found_keys(spark, sf_dir):
    """Write-backs to every customer, against the table that the whole log
    folds to; a left-anti join gives the keys without a row."""
    current = FO.fold(events_changes_of(spark, sf_dir), EVENT_COLUMNS)
    patches = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("key"))
    return FO.not_found_keys(patches, current).select(F.col("key").cast("bigint").alias("user_id"))


_BODY_ROWS = 64  # records of one bulk request


@register("ingest_tally", sql=f"""
WITH r AS (
  SELECT event_type, event_id // {_BODY_ROWS} AS body FROM events
), good AS (
  SELECT 'source ' || body % 3 AS source,
         COUNT(*) FILTER (WHERE event_type NOT IN ('view', 'error')) AS upserted,
         COUNT(*) FILTER (WHERE event_type = 'view') AS skipped,
         COUNT(*) FILTER (WHERE event_type = 'error') AS errors
  FROM r WHERE body % 11 <> 4 GROUP BY 1
), refused AS (
  SELECT 'source ' || body % 3 AS source, COUNT(DISTINCT body) AS n FROM r WHERE body % 11 = 4 GROUP BY 1
)
SELECT source, coalesce(upserted, 0) AS upserted, coalesce(skipped, 0) AS skipped,
       coalesce(errors, 0) + coalesce(n, 0) AS errors
FROM good FULL OUTER JOIN refused USING (source)""")
def ingest_tally(spark, sf_dir):
    """Per source, rows upserted, skipped (no key) and in error (an unknown
    column, or a body that does not parse, refused whole) of bulk requests that
    the ingest itself reads: every event as a JSON record, views without a key,
    errors with a column that the table lacks, every eleventh body cut short."""
    from shipfold.operators import changes as C
    from shipfold.profiles import TableProfile
    from shipfold.sources import json as J
    ev = table(spark, sf_dir, "events")
    t = F.col("event_type")
    record = F.to_json(F.struct(
        F.when(t == "view", F.lit(" nan ")).otherwise(F.col("user_id").cast("string")).alias("user_id"),
        F.col("value").cast("string").alias("Value"), F.when(t == "error", F.col("event_id")).alias("debug_note")))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", record.alias("j")))), lambda r: r["j"]), ",")
    bodies = ev.groupBy(F.floor(F.col("event_id") / _BODY_ROWS).alias("body")).agg(body.alias("rows"))  # _BODY_ROWS rows each
    bodies = bodies.select("body", F.concat(F.lit("["), "rows", F.when(F.col("body") % 11 == 4, "").otherwise("]")).alias("payload"))
    profile = TableProfile("events", "user_id", ("user_id", "value", "props"))
    source = lambda c: F.concat(F.lit("source "), (F.col(c) % 3).cast("string")).alias("source")
    rows = J.explode_rows(bodies, "payload", "body")
    changes, skipped = C.bulk_changes(rows, profile, F.struct("body", "pos"), F.lit("2030-01-01 00:00:00"))
    valid, errors = C.unknown_column_split(changes, profile)
    return A.ingest_tally(
        valid.select(source("seq.body"), F.lit("upserted").alias("disposition"))
        .unionByName(skipped.select(source("body"), F.lit("skipped").alias("disposition")))
        .unionByName(errors.select(source("seq.body"), F.lit("error").alias("disposition")))
        .unionByName(J.json_rejects(bodies, "payload", "body").select(source("body"), F.lit("error").alias("disposition"))))


@register("error_sample", sql="""
SELECT event_id, user_id, ts FROM events WHERE event_type = 'error'
ORDER BY event_id LIMIT 5""")
def error_sample(spark, sf_dir):
    """The first five errors by sequence."""
    ev = table(spark, sf_dir, "events").filter(F.col("event_type") == "error")
    return P.first_n(ev.select("event_id", "user_id", "ts"), ["event_id"], 5)


@register("patch_fields", sql="""
SELECT event_id,
       CASE WHEN event_type = 'click' THEN 'value' ELSE 'props' END AS fields
FROM events WHERE event_type IN ('click', 'view')""")
def patch_fields(spark, sf_dir):
    """P10: a patch keeps only its non-NULL fields (names, comma-joined)."""
    ev = table(spark, sf_dir, "events").filter(F.col("event_type").isin("click", "view"))
    payload = F.create_map(
        F.lit("value"), F.when(F.col("event_type") == "click", F.col("value").cast("string")),
        F.lit("props"), F.when(F.col("event_type") == "view", F.col("props")))
    return ev.select("event_id", F.array_join(F.array_sort(F.map_keys(N.patch_fields(payload))), ",")
                     .alias("fields"))


@register("changed_columns", sql="""
SELECT event_id,
       CASE WHEN event_type = 'click' THEN 'last_updated,value'
            WHEN event_type = 'view' THEN 'last_updated,props'
            WHEN event_type = 'error' THEN 'last_updated,value'
            WHEN event_type = 'purchase' THEN 'last_updated' || CASE WHEN props IS NULL THEN '' ELSE ',props' END
                 || CASE WHEN value IS NULL THEN '' ELSE ',value' END
            ELSE 'last_updated,props,value' END AS updated
FROM events""")
def changed_columns(spark, sf_dir):
    """Names a change sets, plus the stamp, sorted (comma-joined)."""
    ch = events_changes_of(spark, sf_dir)
    return ch.select(F.col("seq").alias("event_id"),
                     F.array_join(N.changed_columns("fields"), ",").alias("updated"))


@register("canonical_key", sql="""
SELECT event_id,
       '[["event_type",' || to_json(event_type) || '],["user",' || to_json(CAST(user_id AS VARCHAR)) || ']]' AS fingerprint
FROM events""")
def canonical_key(spark, sf_dir):
    """Key-order independent fingerprint of a filter map (keys sorted)."""
    ev = table(spark, sf_dir, "events")
    m = F.create_map(F.lit("user"), F.col("user_id").cast("string"),
                     F.lit("event_type"), F.col("event_type"))
    return ev.select("event_id", T.canonical_key(m).alias("fingerprint"))


@register("token_clean", sql="""
SELECT event_id,
       CASE WHEN trim(props) IN ('', 'nan', 'None') THEN NULL ELSE trim(props) END AS bulk_value,
       CASE WHEN lower(trim(event_type)) IN ('', 'nan', 'none', '-') THEN NULL ELSE trim(event_type) END AS scrape_value
FROM events""")
def token_clean(spark, sf_dir):
    """bulk and scrape cleaning of text values."""
    ev = table(spark, sf_dir, "events")
    return ev.select("event_id", T.token_clean_bulk("props").alias("bulk_value"),
                     T.token_clean_scrape("event_type").alias("scrape_value"))
