"""Queries over the shipment list (orders bound as import-confirm rows):
facets, top-k, counts, filters, paging."""

from __future__ import annotations

from pyspark.sql import functions as F

from shipfold.operators import aggregates as A
from shipfold.operators import changes as C
from shipfold.operators import facet_state as FS
from shipfold.operators import filters as F_
from shipfold.operators import normalise as N
from shipfold.operators import page_index as PI
from shipfold.operators import paging as P
from shipfold.operators import tables as TB
from shipfold.plans.registry import register
from shipfold.plans.tables import SHIPMENTS_SQL, shipments_of, table
from shipfold.profiles import IMPORT_CONFIRM_RECORD_KEYS, IMPORT_CONFIRM_VIEW_DEFAULTS
from shipfold.session import default_parallelism, scratch_dir

_FACET_REPORT_SQL = f"""
WITH {SHIPMENTS_SQL},
agg AS (
  SELECT COALESCE(NULLIF(status, ''), 'Unknown') AS s,
         COALESCE(NULLIF(bot_status, ''), 'pending') AS b,
         airline, firm_code
  FROM shipments
),
airline_top AS (
  SELECT airline AS label, COUNT(*) AS cnt FROM agg WHERE airline IS NOT NULL
  GROUP BY airline ORDER BY cnt DESC, label ASC LIMIT 10
),
firm_top AS (
  SELECT firm_code AS label, COUNT(*) AS cnt FROM agg WHERE firm_code IS NOT NULL
  GROUP BY firm_code ORDER BY cnt DESC, label ASC LIMIT 10
)
SELECT 'total' AS facet, CAST(NULL AS VARCHAR) AS label, COUNT(*) AS cnt FROM agg
UNION ALL SELECT 'by_status', s, COUNT(*) FROM agg GROUP BY s
UNION ALL SELECT 'by_bot_status', b, COUNT(*) FROM agg GROUP BY b
UNION ALL SELECT 'by_airline', label, cnt FROM airline_top
UNION ALL SELECT 'by_firm_code', label, cnt FROM firm_top
"""


@register("facet_report", sql=_FACET_REPORT_SQL)
def facet_report(spark, sf_dir):
    """A5: the whole stats report from one scan of the shipment list."""
    return A.facet_report(
        shipments_of(spark, sf_dir),
        labelled={"by_status": ("status", "Unknown"), "by_bot_status": ("bot_status", "pending")},
        top={"by_airline": "airline", "by_firm_code": "firm_code"},
    )


def _ws(body: str) -> str:
    return f"WITH {SHIPMENTS_SQL}\n{body}"


_SHIP_COLS = "row_seq, mawb, status, bot_status, airline, firm_code, eta, pod, o_totalprice"


@register("table_scan", sql=_ws(f"SELECT {_SHIP_COLS} FROM shipments"))
def table_scan(spark, sf_dir):
    """The whole shipment list (column-pruned scan)."""
    return shipments_of(spark, sf_dir)


@register("eq_filter", sql=_ws(
    f"SELECT {_SHIP_COLS} FROM shipments WHERE status = 'F' AND pod = '1-URGENT'"))
def eq_filter(spark, sf_dir):
    """given, non-empty parameters only; ``pod`` reaches Parquet as a
    pushed filter."""
    return F_.eq_filter(shipments_of(spark, sf_dir),
                        {"status": "F", "pod": "1-URGENT", "airline": None, "firm_code": ""})


@register("sentinel_filter", sql=_ws(
    f"SELECT {_SHIP_COLS} FROM shipments WHERE pod = '2-HIGH' AND firm_code = '1995-03'"))
def sentinel_filter(spark, sf_dir):
    """``All`` and empty mean no filter."""
    return F_.sentinel_filter(shipments_of(spark, sf_dir),
                              {"pod": "2-HIGH", "status": "All", "airline": "", "firm_code": "1995-03"})


@register("like_filter", sql=_ws(f"SELECT {_SHIP_COLS} FROM shipments WHERE mawb ILIKE '%1_3%'"))
def like_filter(spark, sf_dir):
    """LIKE contains, the ``_`` in the value stays a wildcard."""
    return F_.like_filter(shipments_of(spark, sf_dir), "mawb", "1_3")


@register("contains_filter", sql=_ws(
    f"SELECT {_SHIP_COLS} FROM shipments WHERE strpos(lower(coalesce(status, '')), 'unk') > 0"))
def contains_filter(spark, sf_dir):
    """literal, case-insensitive substring; NULL is ''."""
    return F_.contains_filter(shipments_of(spark, sf_dir), "status", "UNK")


@register("select_filter", sql=_ws(
    f"SELECT {_SHIP_COLS} FROM shipments WHERE strpos(lower(coalesce(bot_status, '')), 'eta') > 0"))
def select_filter(spark, sf_dir):
    """the select filter as coded, a substring match: 'ETA' picks no_eta."""
    return F_.select_filter(shipments_of(spark, sf_dir), "bot_status", "ETA")


@register("date_range_filter", sql=_ws(
    f"SELECT {_SHIP_COLS} FROM shipments WHERE coalesce(eta, '') >= '1995-01-01' "
    "AND coalesce(eta, '') <= '1995-06-30' || chr(65535)"))
def date_range_filter(spark, sf_dir):
    """inclusive lexical range; the bare end date covers its whole day."""
    return F_.date_range_filter(shipments_of(spark, sf_dir), "eta", "1995-01-01", "1995-06-30")


@register("grid_filter", sql=_ws(
    f"SELECT {_SHIP_COLS} FROM shipments WHERE strpos(lower(coalesce(status, '')), 'f') > 0 "
    "AND coalesce(eta, '') <= '1996-12-31' || chr(65535) "
    "AND strpos(lower(coalesce(airline, '')), '1') > 0"))
def grid_filter(spark, sf_dir):
    """all active column filters; trimmed; empty and All ignored; an
    end-only range lets blank cells through."""
    return F_.grid_filter(shipments_of(spark, sf_dir), {
        "status": " f ", "pod": "All", "firm_code": "  ",
        "eta": {"start": "", "end": "1996-12-31"}, "airline": "1"})


@register("point_lookup", sql=_ws(f"SELECT {_SHIP_COLS} FROM shipments WHERE mawb = '777'"))
def point_lookup(spark, sf_dir):
    """F8: one row by key (empty result = not found)."""
    return F_.point_lookup(shipments_of(spark, sf_dir), "mawb", "777")


@register("indexed_lookup", sql=_ws(f"SELECT {_SHIP_COLS} FROM shipments WHERE mawb = '777'"))
def indexed_lookup(spark, sf_dir):
    """F8 on a published snapshot clustered by its key, with Bloom filters: the
    stored key is filtered as it is, so other files' row groups are skipped."""
    root = scratch_dir(spark, "lookup")
    TB.publish_snapshot(spark, shipments_of(spark, sf_dir), root, 1, cluster_key="mawb")
    return F_.point_lookup(TB.read_snapshot(spark, root), "mawb", "777")


@register("page_seek", sql=_ws(
    f"SELECT {_SHIP_COLS} FROM shipments ORDER BY firm_code DESC NULLS LAST, row_seq DESC LIMIT 50 OFFSET 1000"))
def page_seek(spark, sf_dir):
    """L1 far into the list: the rank index names the slices that hold the page,
    and only they are read."""
    root, order = scratch_dir(spark, "pages"), ["firm_code", "row_seq"]
    PI.write_page_index(shipments_of(spark, sf_dir), order, root, 2 * default_parallelism(spark))
    return PI.seek_page(spark, root, order, page=21, page_size=50)


_FACETS = {"by_status": ("status", "Unknown"), "by_bot_status": ("bot_status", "pending")}
_TOP_FACETS = {"by_airline": "airline", "by_firm_code": "firm_code"}


def shipment_batches(shipments):
    """The shipment list as three batches of changes: all rows, every other one with values
    that do not last; these rows' own values; a third of all rows again, unchanged."""
    columns = ("status", "bot_status", "airline", "firm_code")
    own = F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c))])
    first = F.create_map(*[x for c in columns for x in (F.lit(c), F.concat(F.lit("x"), F.col("firm_code")))])
    n = F.col("row_seq")

    def batch(rows, fields, kind, number):
        return C.change_frame(rows, F.col("mawb"), n + F.lit(number << 40), F.lit(kind), fields,
                              F.lit("2030-01-01 00:00:00").cast("timestamp_ntz"))

    return columns, [batch(shipments, F.when(n % 2 == 0, first).otherwise(own), C.UPSERT, 1),
                     batch(shipments.filter(n % 2 == 0), own, C.PATCH, 2), batch(shipments.filter(n % 3 == 0), own, C.PATCH, 3)]


@register("facet_increments", sql=_FACET_REPORT_SQL)
def facet_increments(spark, sf_dir):
    """A2-A6 kept up to date: the shipment list published as three batches of
    changes, each adjusting the counts by the rows it touches."""
    root = scratch_dir(spark, "facets")
    columns, batches = shipment_batches(shipments_of(spark, sf_dir))
    for k, changes in enumerate(batches, 1):
        FS.publish_batch(changes, root, k, columns, _FACETS, _TOP_FACETS)
    return FS.read_report(spark, root, _TOP_FACETS, A.TOP_K)


@register("filtered_count", sql=_ws(
    "SELECT COUNT(*) AS total FROM shipments WHERE status = 'F'"))
def filtered_count(spark, sf_dir):
    """A1: COUNT(*) with the list's filters."""
    return A.filtered_count(shipments_of(spark, sf_dir), F.col("status") == "F")


@register("facet_status", sql=_ws(
    "SELECT COALESCE(NULLIF(status, ''), 'Unknown') AS label, COUNT(*) AS cnt "
    "FROM shipments GROUP BY 1"))
def facet_status(spark, sf_dir):
    """A2: by status; NULL, '' and the literal default are summed."""
    return A.facet_status(shipments_of(spark, sf_dir))


@register("facet_bot_status", sql=_ws(
    "SELECT COALESCE(NULLIF(bot_status, ''), 'pending') AS label, COUNT(*) AS cnt "
    "FROM shipments GROUP BY 1"))
def facet_bot_status(spark, sf_dir):
    """A3: by bot status; NULL and '' count as pending."""
    return A.facet_bot_status(shipments_of(spark, sf_dir))


@register("topk_category", sql=_ws(
    "SELECT airline AS label, COUNT(*) AS cnt FROM shipments WHERE airline IS NOT NULL "
    "GROUP BY airline ORDER BY cnt DESC, label ASC LIMIT 10"))
def topk_category(spark, sf_dir):
    """A4: top ten airlines, ties broken by value."""
    return A.top_k(shipments_of(spark, sf_dir), "airline")


@register("dashboard_cards", sql=_ws(
    "SELECT s.total, s.bot_pending, s.bot_arrived, p.pickup_total FROM "
    "(SELECT COUNT(*) AS total, "
    "  COUNT(*) FILTER (WHERE COALESCE(NULLIF(bot_status, ''), 'pending') = 'pending') AS bot_pending, "
    "  COUNT(*) FILTER (WHERE bot_status = 'arrived') AS bot_arrived FROM shipments) s, "
    "(SELECT COUNT(*) AS pickup_total FROM lineitem) p"))
def dashboard_cards(spark, sf_dir):
    """The four dashboard cards; line items stand in for pickups."""
    return A.dashboard_cards(shipments_of(spark, sf_dir), table(spark, sf_dir, "lineitem"))


@register("distinct_options", sql=_ws(
    "SELECT 'All' AS value, TRUE AS is_sentinel "
    "UNION ALL SELECT DISTINCT firm_code, FALSE FROM shipments "
    "WHERE firm_code IS NOT NULL AND firm_code <> ''"))
def distinct_options(spark, sf_dir):
    """Sorted distinct non-blank values with ``All`` first."""
    return A.distinct_options(shipments_of(spark, sf_dir), "firm_code")


@register("table_counts", sql=
    "SELECT 'import_confirm' AS table_name, COUNT(*) AS row_count FROM orders "
    "UNION ALL SELECT 'pickup_report', COUNT(*) FROM lineitem "
    "UNION ALL SELECT 'change_log', COUNT(*) FROM events")
def table_counts(spark, sf_dir):
    """Row count per table."""
    return A.table_counts({
        "import_confirm": table(spark, sf_dir, "orders"),
        "pickup_report": table(spark, sf_dir, "lineitem"),
        "change_log": table(spark, sf_dir, "events"),
    })


@register("union_distinct", sql=_ws(
    "SELECT airline AS value FROM shipments WHERE status = 'F' "
    "UNION SELECT airline FROM shipments WHERE pod = '1-URGENT'"))
def union_distinct(spark, sf_dir):
    """Union of two selections, distinct, ascending."""
    s = shipments_of(spark, sf_dir)
    return A.union_distinct(s.filter(F.col("status") == "F").select(F.col("airline").alias("value")),
                            s.filter(F.col("pod") == "1-URGENT").select(F.col("airline").alias("value")))


@register("page_desc", sql=_ws(
    f"SELECT {_SHIP_COLS} FROM shipments WHERE pod = '3-MEDIUM' "
    "ORDER BY row_seq DESC LIMIT 50 OFFSET 100"))
def page_desc(spark, sf_dir):
    """L1: third page of 50, newest first, of a filtered list."""
    s = F_.eq_filter(shipments_of(spark, sf_dir), {"pod": "3-MEDIUM"})
    return P.page_desc(s, "row_seq", page=3, page_size=50)


@register("list_asc", sql=_ws(
    f"SELECT {_SHIP_COLS} FROM shipments WHERE pod = '1-URGENT' AND mawb ILIKE '%9%' "
    "ORDER BY row_seq ASC"))
def list_asc(spark, sf_dir):
    """L2: the milestone list: All-sentinel filters, LIKE on key, oldest first."""
    s = F_.sentinel_filter(shipments_of(spark, sf_dir), {"pod": "1-URGENT", "status": "All"})
    return P.list_asc(F_.like_filter(s, "mawb", "9"), "row_seq")


@register("page_envelope", sql=_ws(
    "SELECT COUNT(*) AS total, CAST(7 AS BIGINT) AS page, CAST(200 AS BIGINT) AS page_size, "
    "GREATEST(1, CAST(CEIL(COUNT(*) / 200.0) AS BIGINT)) AS pages, "
    "GREATEST(0, LEAST(200, COUNT(*) - 1200)) AS items_on_page "
    "FROM shipments WHERE pod = '1-URGENT'"))
def page_envelope(spark, sf_dir):
    """Total, page, size, page count (at least 1), rows on the page."""
    s = F_.eq_filter(shipments_of(spark, sf_dir), {"pod": "1-URGENT"})
    return P.page_envelope(s, page=7, page_size=200)


_SEEDED = {"mawb": "mawb", "status": "status", "airline": "airline", "firm_code": "firm_code", "eta": "eta", "pod": "pod"}


@register("seed_view", sql=_ws("SELECT " + ", ".join(
    f"COALESCE(NULLIF({_SEEDED[c]}, ''), '{IMPORT_CONFIRM_VIEW_DEFAULTS.get(c, '')}') AS \"{name}\"" if c in _SEEDED
    else f"'{IMPORT_CONFIRM_VIEW_DEFAULTS.get(c, '')}' AS \"{name}\"" for name, c in IMPORT_CONFIRM_RECORD_KEYS.items())
    + " FROM shipments"))
def seed_view(spark, sf_dir):
    """P6 + P7 with the shipped key maps: the shipment list as seed records (JSON, their own
    names, blanks left out), renamed to columns (missing -> ''), and back to view names
    with the grid's defaults."""
    names = {c: n for n, c in IMPORT_CONFIRM_RECORD_KEYS.items()}
    s = shipments_of(spark, sf_dir)
    record = F.to_json(F.struct(*[F.col(c).alias(names[k]) for k, c in _SEEDED.items()]))  # nulls are left out
    rows = s.select(F.from_json(record, "map<string,string>").alias("m"))
    columns = rows.select(*N.rename_default("m", IMPORT_CONFIRM_RECORD_KEYS))
    return N.view_rows(columns, IMPORT_CONFIRM_RECORD_KEYS, IMPORT_CONFIRM_VIEW_DEFAULTS)


@register("view_defaults", sql=_ws(
    "SELECT mawb, COALESCE(NULLIF(status, ''), 'New') AS status, "
    "COALESCE(NULLIF(bot_status, ''), '') AS bot_status, "
    "COALESCE(NULLIF(airline, ''), '') AS airline FROM shipments"))
def view_defaults(spark, sf_dir):
    """null/blank -> the grid's default per column."""
    s = shipments_of(spark, sf_dir)
    return N.view_defaults(s, ["mawb", "status", "bot_status", "airline"],
                           {"status": "New"})
