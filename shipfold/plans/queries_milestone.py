"""Milestone queries (orders + line items bound as the ATD/ATA table) and
scalar text functions over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from shipfold.functions import milestone as M
from shipfold.functions import text as T
from shipfold.operators import changes as C
from shipfold.operators import filters as F_
from shipfold.operators import fold as FO
from shipfold.plans.registry import register
from shipfold.plans.sql_helpers import browser_trim, collapse, strip
from shipfold.plans.tables import MILESTONES_SQL, milestones_of, table
from shipfold.session import scratch_dir

_STATUS_SQL = ("CASE WHEN NULLIF(ata, '') IS NOT NULL THEN 'Completed' "
               "WHEN NULLIF(atd, '') IS NOT NULL THEN 'Pending Arrival' ELSE 'Pending Depart' END")


@register("milestone_status", sql=f"WITH {MILESTONES_SQL} SELECT mawb, atd, ata, {_STATUS_SQL} AS status FROM milestones")
def milestone_status(spark, sf_dir):
    """Completed / Pending Arrival / Pending Depart from ata and atd."""
    m = milestones_of(spark, sf_dir)
    return m.select("mawb", "atd", "ata", M.milestone_status("atd", "ata").alias("status"))


NOW = "2024-01-15 12:00:00"


@register("time_rule", sql=f"""
WITH c AS (SELECT event_id, date_trunc('minute', ts) AS cap, TIMESTAMP '{NOW}' AS now FROM events)
SELECT event_id,
       CASE WHEN cap < now - INTERVAL 3 HOUR
            THEN strftime(date_trunc('minute', now - INTERVAL 150 MINUTE), '%Y-%m-%d %H:%M:00')
            ELSE strftime(cap, '%Y-%m-%d %H:%M:00') END AS value,
       CASE WHEN cap < now - INTERVAL 3 HOUR THEN '{M.RULE_ROLLBACK}'
            WHEN cap > now + INTERVAL 24 HOUR THEN '{M.RULE_SCHEDULED}'
            ELSE '{M.RULE_DIRECT}' END AS rule
FROM c""")
def time_rule(spark, sf_dir):
    """Suggested milestone time for each captured time (minute
    precision) at a fixed ``now``; all three rules occur."""
    ev = table(spark, sf_dir, "events")
    r = M.time_rule_ts(F.date_trunc("minute", "ts").cast("timestamp_ntz"),
                       F.lit(NOW).cast("timestamp_ntz"))
    return ev.select("event_id", r["value"].alias("value"), r["rule"].alias("rule"))


_SEED_SQL = "COALESCE(NULLIF(atd, ''), NULLIF(etd_orig, ''), '')"


@register("captured_seed", sql=f"WITH {MILESTONES_SQL} SELECT mawb, {_SEED_SQL} AS seed FROM milestones")
def captured_seed(spark, sf_dir):
    """The dialog's starting value: existing atd, else the scheduled
    departure, else ''."""
    m = milestones_of(spark, sf_dir)
    return m.select("mawb", M.captured_seed("atd", "etd_orig").alias("seed"))


@register("datetime_parts", sql=f"""WITH {MILESTONES_SQL},
s AS (SELECT mawb, COALESCE(NULLIF(ata, ''), '') AS seed FROM milestones),
p AS (SELECT mawb, COALESCE(string_split(seed, ' ')[1], '') AS d,
             substr(COALESCE(string_split(seed, ' ')[2], ''), 1, 5) AS t FROM s)
SELECT mawb, d AS date_part, t AS time_part, d || ' ' || t || ':00' AS joined FROM p""")
def datetime_parts(spark, sf_dir):
    """Split a date-time into date and HH:mm, and join them back with
    ':00' seconds."""
    m = milestones_of(spark, sf_dir)
    seed = M.captured_seed("ata", F.lit(None).cast("string"))
    d, t = M.date_part(seed), M.time_part(seed)
    return m.select("mawb", d.alias("date_part"), t.alias("time_part"),
                    M.join_datetime(d, t).alias("joined"))


BATCH_VALUE = "2024-01-15 12:00:00"


@register("batch_apply", sql=f"""WITH {MILESTONES_SQL},
sel AS (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS mawb FROM lineitem WHERE l_returnflag = 'A'),
upd AS (
  SELECT m.mawb, CASE WHEN sel.mawb IS NOT NULL THEN '{BATCH_VALUE}' ELSE m.atd END AS atd, m.ata,
         sel.mawb IS NOT NULL AS patched
  FROM milestones m LEFT JOIN sel USING (mawb))
SELECT mawb, atd, ata, {_STATUS_SQL} AS status FROM upd""")
def batch_apply(spark, sf_dir):
    """J3 + S8 + fold rule 6: rows selected by a semi join get a batch ATD
    write-back; the fold derives each patched row's status from its final
    atd/ata, seeded rows keep theirs. The milestones are written once: the seeds
    and the selection both read them."""
    path = scratch_dir(spark, "milestones")
    milestones_of(spark, sf_dir).write.parquet(path)
    m = spark.read.parquet(path)
    seed_fields = F.create_map(
        F.lit("mawb"), F.col("mawb"), F.lit("atd"), F.col("atd"), F.lit("ata"), F.col("ata"),
        F.lit("status"), M.milestone_status("atd", "ata"))
    t0 = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    seeds = C.change_frame(m, F.col("mawb"), F.lit(0).cast("bigint"), F.lit(C.REPLACE), seed_fields, t0)
    li = table(spark, sf_dir, "lineitem").filter(F.col("l_returnflag") == "A")
    keys = li.select(F.col("l_orderkey").cast("string").alias("mawb")).distinct()
    selected = F_.multi_lookup(m.select("mawb"), "mawb", keys)
    patches = C.patch_changes(selected, F.col("mawb"), F.create_map(F.lit("atd"), F.lit(BATCH_VALUE)),
                              F.lit(1).cast("bigint"), F.lit(BATCH_VALUE).cast("timestamp_ntz"))
    cur = FO.fold(seeds.unionByName(patches), ("atd", "ata", "status"), milestone=True, key_name="mawb")
    return cur.select("mawb", "atd", "ata", "status")


@register("first_int", sql="SELECT page_id, TRY_CAST(NULLIF(regexp_extract(url, '(\\d+)', 1), '') AS BIGINT) AS n FROM pages")
def first_int(spark, sf_dir):
    """First run of digits in a text as a number."""
    return table(spark, sf_dir, "pages").select("page_id", T.first_int("url").alias("n"))


@register("html_escape", sql="""
SELECT doc_id, replace(replace(replace(replace(COALESCE(text, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS escaped
FROM documents""")
def html_escape(spark, sf_dir):
    """Escape & < > " over whole document texts."""
    return table(spark, sf_dir, "documents").select("doc_id", T.html_escape("text").alias("escaped"))


@register("collapse_ws", sql=f"SELECT doc_id, {collapse('text')} AS collapsed FROM documents")
def collapse_ws(spark, sf_dir):
    """Runs of white space to one space, stripped, over whole texts."""
    return table(spark, sf_dir, "documents").select("doc_id", T.collapse_ws("text").alias("collapsed"))


@register("tag_split", sql=f"""
SELECT doc_id,
       CAST(CASE WHEN text IS NULL OR text = '' THEN 0 ELSE len(string_split(text, ',')) END AS INTEGER) AS n_tags,
       CASE WHEN text IS NULL OR text = '' THEN ''
            ELSE array_to_string(list_transform(string_split(text, ','), lambda x: {browser_trim('x')}), ', ') END AS tags
FROM documents""")
def tag_split(spark, sf_dir):
    """Comma lists to trimmed tags (a trailing comma gives an empty
    tag) and back, over whole texts."""
    tags = T.tag_split("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.size(tags).alias("n_tags"), T.tag_join(tags).alias("tags"))
