"""Queries over row selections and published versions: bitmaps, exact top-k, the gram
index and the change feed."""

from __future__ import annotations

from pyspark.sql import functions as F

from shipfold.operators import bitmaps as BM
from shipfold.operators import change_feed as CF
from shipfold.operators import exact_topk as XK
from shipfold.operators import fold as FO
from shipfold.operators import gram_index as GI
from shipfold.operators import tables as TB
from shipfold.plans.queries_list import _SHIP_COLS, _ws
from shipfold.plans.queries_tables import published_state
from shipfold.plans.registry import register
from shipfold.plans.tables import EVENT_COLUMNS, events_changes, fold_sql, shipments_of, table
from shipfold.session import scratch_dir


def _selections(shipments):
    picked = {"finished": F.col("status") == "F", "urgent": F.col("pod") == "1-URGENT",
              "arrived": F.col("bot_status") == "arrived"}
    return BM.selection_bitmaps(shipments, "row_seq", picked)


@register("bitmap_selections", sql=_ws("""
SELECT 'finished' AS selection, COUNT(*) AS row_count FROM shipments WHERE status = 'F'
UNION ALL SELECT 'urgent', COUNT(*) FROM shipments WHERE pod = '1-URGENT'
UNION ALL SELECT 'arrived', COUNT(*) FROM shipments WHERE bot_status = 'arrived'
UNION ALL SELECT 'any', COUNT(*) FROM shipments WHERE status = 'F' OR pod = '1-URGENT' OR bot_status = 'arrived'
UNION ALL SELECT 'urgent and arrived', COUNT(*) FROM shipments WHERE pod = '1-URGENT' AND bot_status = 'arrived'"""))
def bitmap_selections(spark, sf_dir):
    """U1 on bitmaps: three selections of the shipment list from one scan, their union and
    an intersection, counted on the bitmaps."""
    path = scratch_dir(spark, "bitmaps")
    _selections(shipments_of(spark, sf_dir)).write.parquet(path)
    maps = spark.read.parquet(path)
    either = BM.united(maps, ["finished", "urgent", "arrived"], "any")
    both = BM.common(maps, ["urgent", "arrived"], "urgent and arrived")
    return BM.row_counts(maps.unionByName(either).unionByName(both))


@register("bitmap_rows", sql=_ws(
    f"SELECT {_SHIP_COLS} FROM shipments WHERE pod = '1-URGENT' AND bot_status = 'arrived'"))
def bitmap_rows(spark, sf_dir):
    """J3 on bitmaps: the rows of an intersection of two selections, by a join on row-number
    buckets."""
    s = shipments_of(spark, sf_dir)
    return BM.selected_rows(s, "row_seq", BM.common(_selections(s), ["urgent", "arrived"], "both"))


@register("topk_exact", sql=_ws("""
SELECT * FROM (SELECT 'airline' AS facet, airline AS label, COUNT(*) AS cnt FROM shipments WHERE airline IS NOT NULL
  GROUP BY airline ORDER BY cnt DESC, label ASC LIMIT 10)
UNION ALL SELECT * FROM (SELECT 'mawb', mawb AS label, COUNT(*) AS cnt FROM shipments GROUP BY mawb ORDER BY cnt DESC, label ASC LIMIT 10)
UNION ALL SELECT * FROM (SELECT 'firm_code', firm_code AS label, COUNT(*) AS cnt FROM shipments WHERE firm_code IS NOT NULL
  GROUP BY firm_code ORDER BY cnt DESC, label ASC LIMIT 10)"""))
def topk_exact(spark, sf_dir):
    """A4 without a shuffle of the values: many values (airline), only different ones (mawb, where
    nothing is settled early) and few (firm_code)."""
    s = shipments_of(spark, sf_dir)
    parts = [XK.exact_top_k(s, c).select(F.lit(c).alias("facet"), "label", "cnt") for c in ("airline", "mawb", "firm_code")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("gram_like", sql="""
SELECT doc_id, lang, source, n_chars FROM documents
WHERE translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%apache%licen_e%'""")
def gram_like(spark, sf_dir):
    """F3 over whole texts by the gram index: the index is written, the rarest grams of the
    pattern give candidates, the filter decides."""
    docs, root = table(spark, sf_dir, "documents"), scratch_dir(spark, "grams")
    GI.write_gram_index(docs, "doc_id", "text", root)
    return GI.search_like(docs, "doc_id", "text", "Apache%Licen_e", root).select("doc_id", "lang", "source", "n_chars")


_CUTOFF = "2024-01-30 12:00:00"
_VERSIONS_SQL = f"""
WITH was AS ({fold_sql().replace("FROM events ", f"FROM events WHERE ts < TIMESTAMP '{_CUTOFF}' ")}),
now AS ({fold_sql()}),
both_versions AS (
  SELECT COALESCE(was.user_id, now.user_id) AS user_id, now.value, now.props,
         CASE WHEN was.user_id IS NULL THEN 'inserted' WHEN now.user_id IS NULL THEN 'deleted'
              WHEN was.value IS NOT DISTINCT FROM now.value AND was.props IS NOT DISTINCT FROM now.props THEN 'unchanged'
              ELSE 'updated' END AS change
  FROM was FULL JOIN now ON was.user_id = now.user_id)"""


def _two_versions(spark, sf_dir):
    """The event log published as two versions: up to the last noon, and whole."""
    root = scratch_dir(spark, "versions")
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")
    early = F.col("ts") < F.lit(_CUTOFF).cast("timestamp_ntz")
    for version, part in ((1, ev.filter(early)), (2, ev.filter(~early))):
        TB.append_changes(events_changes(part), f"{root}/log", version)
        TB.publish_snapshot(spark, published_state(spark, root), f"{root}/snap", version, cluster_key="key")
    return [FO.finish(TB.read_snapshot(spark, f"{root}/snap", v), EVENT_COLUMNS) for v in (1, 2)]


@register("version_changes", sql=f"{_VERSIONS_SQL} SELECT user_id, change FROM both_versions")
def version_changes(spark, sf_dir):
    """X14 + A10: every key of two published versions, as inserted, updated or unchanged."""
    was, now = _two_versions(spark, sf_dir)
    return CF.version_changes(was, now, "key", EVENT_COLUMNS).select(F.col("key").cast("bigint").alias("user_id"), "change")


@register("change_feed", sql=f"{_VERSIONS_SQL} SELECT user_id, change, value, props FROM both_versions WHERE change <> 'unchanged'")
def change_feed(spark, sf_dir):
    """X14 + A10: the rows that differ between two published versions, with their new values."""
    was, now = _two_versions(spark, sf_dir)
    feed = CF.change_feed(was, now, "key", EVENT_COLUMNS)
    return feed.select(F.col("key").cast("bigint").alias("user_id"), "change", F.col("value").cast("double").alias("value"), "props")
