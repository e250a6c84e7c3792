"""Reading the driver's tables and binding them to shipment roles.

Each binding is defined twice, once as DataFrame code and once as SQL text for
the DuckDB oracle, and the two must stay in step. Bindings only project and
relabel columns; they never sample or cap rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# --------------------------------------------------------------------------
# Shipment list: orders as an import-confirm table.
#   row_seq   = o_orderkey (unique, gives the newest-first order)
#   status    = NULL / '' / the literal default label / o_orderstatus, chosen
#               by o_orderpriority, so facets meet all three missing forms
#   bot_status= arrived (F), pending (O), else NULL / '' / no_eta by priority
#   airline   = customer key as text, NULL for low priority (top-k with ties)
#   firm_code = order month
#   eta       = order date-time text, '' for one priority (range filters)
# --------------------------------------------------------------------------

def _status(prio: Column, status: Column) -> Column:
    return (F.when(prio == "5-LOW", F.lit(None).cast("string"))
            .when(prio == "4-NOT SPECIFIED", F.lit(""))
            .when(prio == "3-MEDIUM", F.lit("Unknown"))
            .otherwise(status))


def _bot_status(prio: Column, status: Column) -> Column:
    return (F.when(status == "F", F.lit("arrived"))
            .when(status == "O", F.lit("pending"))
            .when(prio == "1-URGENT", F.lit(None).cast("string"))
            .when(prio == "2-HIGH", F.lit(""))
            .otherwise(F.lit("no_eta")))


def shipments(orders: DataFrame) -> DataFrame:
    prio, status = F.col("o_orderpriority"), F.col("o_orderstatus")
    return orders.select(
        F.col("o_orderkey").alias("row_seq"),
        F.col("o_orderkey").cast("string").alias("mawb"),
        _status(prio, status).alias("status"),
        _bot_status(prio, status).alias("bot_status"),
        F.when(prio == "5-LOW", F.lit(None).cast("string"))
         .otherwise(F.col("o_custkey").cast("string")).alias("airline"),
        F.date_format("o_orderdate", "yyyy-MM").alias("firm_code"),
        F.when(prio == "4-NOT SPECIFIED", F.lit(""))
         .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).alias("eta"),
        F.col("o_orderpriority").alias("pod"),
        F.col("o_totalprice"),
    )


SHIPMENTS_SQL = """
shipments AS (
  SELECT o_orderkey AS row_seq,
         CAST(o_orderkey AS VARCHAR) AS mawb,
         CASE WHEN o_orderpriority = '5-LOW' THEN NULL
              WHEN o_orderpriority = '4-NOT SPECIFIED' THEN ''
              WHEN o_orderpriority = '3-MEDIUM' THEN 'Unknown'
              ELSE o_orderstatus END AS status,
         CASE WHEN o_orderstatus = 'F' THEN 'arrived'
              WHEN o_orderstatus = 'O' THEN 'pending'
              WHEN o_orderpriority = '1-URGENT' THEN NULL
              WHEN o_orderpriority = '2-HIGH' THEN ''
              ELSE 'no_eta' END AS bot_status,
         CASE WHEN o_orderpriority = '5-LOW' THEN NULL
              ELSE CAST(o_custkey AS VARCHAR) END AS airline,
         strftime(o_orderdate, '%Y-%m') AS firm_code,
         CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN ''
              ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS eta,
         o_orderpriority AS pod,
         o_totalprice
  FROM orders
)"""


def shipments_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shipments(table(spark, sf_dir, "orders"))


# --------------------------------------------------------------------------
# Change log: events as changes to a per-user record with columns value, props.
#   signup   -> replace {value, props}
#   purchase -> upload upsert {value, props} (NULL cells absent)
#   click    -> patch {value};  view -> patch {props}  (NULL fields dropped)
#   error    -> bulk upsert {value: NULL} (a present NULL overwrites)
# key = user_id as text, seq = event_id (unique, follows ts), ts = ts.
# --------------------------------------------------------------------------

EVENT_COLUMNS = ("value", "props")


def events_changes(events: DataFrame, types: tuple[str, ...] | None = None) -> DataFrame:
    from shipfold.operators.changes import PATCH, REPLACE, UPSERT, change_frame

    ev = events if types is None else events.filter(F.col("event_type").isin(*types))
    t = F.col("event_type")
    v = F.col("value").cast("string")
    p = F.col("props")
    both = F.create_map(F.lit("value"), v, F.lit("props"), p)
    fields = (F.when(t == "signup", both)
              .when(t == "purchase", F.map_filter(both, lambda _, x: x.isNotNull()))
              .when(t == "click", F.map_filter(F.create_map(F.lit("value"), v), lambda _, x: x.isNotNull()))
              .when(t == "view", F.map_filter(F.create_map(F.lit("props"), p), lambda _, x: x.isNotNull()))
              .otherwise(F.create_map(F.lit("value"), F.lit(None).cast("string"))))
    kind = (F.when(t == "signup", F.lit(REPLACE))
            .when(t.isin("purchase", "error"), F.lit(UPSERT))
            .otherwise(F.lit(PATCH)))
    return change_frame(ev, F.col("user_id"), F.col("event_id"), kind, fields, F.col("ts"), "event_type")


def events_changes_of(spark: SparkSession, sf_dir: str, types: tuple[str, ...] | None = None) -> DataFrame:
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")
    return events_changes(ev, types)


def changes_sql(types: tuple[str, ...] | None = None) -> str:
    where = "" if types is None else "WHERE event_type IN (" + ", ".join(f"'{t}'" for t in types) + ")"
    return f"""
ch AS (
  SELECT CAST(user_id AS VARCHAR) AS key, event_id AS seq, ts, event_type,
         CASE WHEN event_type = 'signup' THEN 'replace'
              WHEN event_type IN ('purchase', 'error') THEN 'upsert'
              ELSE 'patch' END AS kind,
         CASE WHEN event_type IN ('signup', 'error') THEN TRUE
              WHEN event_type IN ('purchase', 'click') THEN value IS NOT NULL
              ELSE FALSE END AS has_value,
         CASE WHEN event_type = 'error' THEN NULL ELSE value END AS v_value,
         CASE WHEN event_type = 'signup' THEN TRUE
              WHEN event_type IN ('purchase', 'view') THEN props IS NOT NULL
              ELSE FALSE END AS has_props,
         props AS v_props
  FROM events {where}
),
ch2 AS (
  SELECT *, (kind <> 'patch' OR has_value OR has_props) AS applicable FROM ch
)"""


def fold_sql(types: tuple[str, ...] | None = None) -> str:
    return f"""WITH {changes_sql(types)},
k AS (
  SELECT key,
         MIN(seq) FILTER (WHERE kind IN ('replace', 'upsert')) AS first_insert,
         MAX(seq) FILTER (WHERE kind = 'replace') AS last_replace,
         MAX(seq) FILTER (WHERE has_value) AS value_seq,
         arg_max_null(v_value, seq) FILTER (WHERE has_value) AS value_last,
         MAX(seq) FILTER (WHERE has_props) AS props_seq,
         arg_max_null(v_props, seq) FILTER (WHERE has_props) AS props_last,
         arg_max(ts, seq) FILTER (WHERE applicable) AS last_ts
  FROM ch2 GROUP BY key
)
SELECT CAST(key AS BIGINT) AS user_id,
       CAST(CASE WHEN value_seq >= COALESCE(last_replace, first_insert) THEN value_last END AS DOUBLE) AS value,
       CASE WHEN props_seq >= COALESCE(last_replace, first_insert) THEN props_last END AS props,
       COALESCE(last_replace, first_insert) AS row_seq,
       last_ts AS last_updated
FROM k WHERE first_insert IS NOT NULL"""


def typed_events_fold(folded: DataFrame) -> DataFrame:
    """Typed view of a folded events table."""
    return folded.select(F.col("key").cast("bigint").alias("user_id"),
                         F.col("value").cast("double").alias("value"),
                         "props", "row_seq", "last_updated")


# --------------------------------------------------------------------------
# Milestones: orders with departure/arrival times from their line items.
#   etd_orig = order date; atd = first ship date of a finished line;
#   ata = last ship date of a finished, returned line (text, NULL if none).
# Line items are aggregated per order first (partial aggregate), then joined.
# --------------------------------------------------------------------------

_TS_FMT = "yyyy-MM-dd HH:mm:ss"


def milestones(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    fin = F.col("l_linestatus") == "F"
    per_order = lineitem.groupBy("l_orderkey").agg(
        F.min(F.when(fin, F.col("l_shipdate"))).alias("_atd"),
        F.max(F.when(fin & (F.col("l_returnflag") == "R"), F.col("l_shipdate"))).alias("_ata"))
    j = orders.select("o_orderkey", "o_orderdate").join(
        per_order, orders["o_orderkey"] == per_order["l_orderkey"], "left")
    return j.select(
        F.col("o_orderkey").alias("row_seq"),
        F.col("o_orderkey").cast("string").alias("mawb"),
        F.date_format("o_orderdate", _TS_FMT).alias("etd_orig"),
        F.date_format("_atd", _TS_FMT).alias("atd"),
        F.date_format("_ata", _TS_FMT).alias("ata"),
    )


def milestones_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return milestones(table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"))


MILESTONES_SQL = """
milestones AS (
  SELECT o_orderkey AS row_seq, CAST(o_orderkey AS VARCHAR) AS mawb,
         strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS etd_orig,
         strftime(l.atd, '%Y-%m-%d %H:%M:%S') AS atd,
         strftime(l.ata, '%Y-%m-%d %H:%M:%S') AS ata
  FROM orders LEFT JOIN (
    SELECT l_orderkey,
           MIN(l_shipdate) FILTER (WHERE l_linestatus = 'F') AS atd,
           MAX(l_shipdate) FILTER (WHERE l_linestatus = 'F' AND l_returnflag = 'R') AS ata
    FROM lineitem GROUP BY l_orderkey) l ON o_orderkey = l.l_orderkey
)"""
