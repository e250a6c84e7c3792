"""Source queries: files and payloads derived from the driver's tables are
written or built by Spark, then read back through the library's readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from shipfold.functions import text as T
from shipfold.operators import aggregates as A
from shipfold.operators import changes as C
from shipfold.operators import fold as FO
from shipfold.operators import normalise as N
from shipfold.plans.registry import register
from shipfold.plans.sql_helpers import strip
from shipfold.plans.tables import table
from shipfold.profiles import IMPORT_CONFIRM, TableProfile
from shipfold.session import default_parallelism, partition_count, scratch_dir
from shipfold.sources import csv as CSV
from shipfold.sources import html_grid as H
from shipfold.sources import json as J
from shipfold.sources import json_records as JR

# -- S1: CSV upload round trip ------------------------------------------------

_CSV_COLUMNS_SQL = """
SELECT CAST(o_orderkey AS VARCHAR) AS mawb,
       CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END AS status,
       CAST(o_custkey AS VARCHAR) AS airline,
       strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS eta,
       CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE 'C-' || CAST(o_custkey AS VARCHAR) END AS hawb_customer,
       'pending' AS bot_status,
       CASE WHEN o_orderpriority = '1-URGENT'
            THEN o_orderkey || ' "Old" Road' || chr(13) || chr(10) || 'Town, ' || o_orderstatus || chr(10) || chr(10)
            WHEN o_orderpriority = '3-MEDIUM' THEN 'Gate ' || o_custkey || ', "B"' END AS address
FROM orders WHERE NOT (o_orderpriority = '2-HIGH' AND o_orderstatus = 'P')"""


def orders_as_upload(orders):
    """Orders as an upload sheet with the headers people type: padded key,
    a spaced header, two aliases of one column (the last one sometimes
    blank), an NA token, a column the table does not know, and addresses, some
    with quotes and commas, urgent orders' with line breaks of both kinds."""
    prio, status = F.col("o_orderpriority"), F.col("o_orderstatus")
    return orders.select(
        F.when((prio == "2-HIGH") & (status == "P"), F.lit("nan"))
         .otherwise(F.concat(F.lit(" "), F.col("o_orderkey").cast("string"), F.lit(" "))).alias("M#"),
        F.when(status == "P", F.lit("N/A")).otherwise(status).alias(" Status "),
        F.col("o_custkey").cast("string").alias("Airline"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("ETA"),
        prio.alias("Customer"),
        F.when(prio == "5-LOW", F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("C-"), F.col("o_custkey").cast("string"))).alias("HAWB Customer"),
        F.col("o_totalprice").cast("string").alias("Unknown Col"),
        F.when(prio == "1-URGENT", F.concat(F.col("o_orderkey").cast("string"), F.lit(' "Old" Road\r\nTown, '),
                                            status, F.lit("\n\n")))
         .when(prio == "3-MEDIUM", F.concat(F.lit("Gate "), F.col("o_custkey").cast("string"), F.lit(', "B"')))
         .alias("Address"),
    )


def upload_to_current(rows, profile: TableProfile, ts):
    """Upload rows -> upserts -> current rows (refused files and rows without a
    key are left out)."""
    ok = rows.filter(F.col("refused").isNull())
    changes, _rejected = C.upload_changes(ok, profile, F.col("row_index"), ts)
    return FO.fold(changes, profile.value_columns, key_name=profile.key)


@register("csv_scan", sql=_CSV_COLUMNS_SQL)
def csv_scan(spark, sf_dir):
    """Orders written as CSV uploads, read back as all-string
    cells, headers mapped by alias, keys checked, folded into current rows. The
    urgent orders' files hold cells with line breaks; a last set of files
    repeats the orders under other keys with rows wider than the header, and
    is refused whole."""
    path = scratch_dir(spark, "csv_scan")
    orders = table(spark, sf_dir, "orders")
    # One upload file per partition; only a tiny input is spread out first.
    files_n = default_parallelism(spark)
    if (partition_count(orders) or files_n) < files_n:
        orders = orders.repartition(files_n)
    urgent = F.col("o_orderpriority") == "1-URGENT"
    sheets = {"plain": orders_as_upload(orders.filter(~urgent)), "urgent": orders_as_upload(orders.filter(urgent))}
    for name, sheet in sheets.items():
        (sheet.write.mode("overwrite").option("escape", '"')
         .option("header", True).option("ignoreLeadingWhiteSpace", False)
         .option("ignoreTrailingWhiteSpace", False).csv(f"{path}/{name}"))
    # Without quoting the comma inside a cell makes one cell more than the header has.
    ragged = orders.select(F.concat(F.lit("R-"), F.col("o_orderkey").cast("string")).alias("M#"),
                           F.concat_ws(",", "o_orderstatus", "o_orderpriority").alias("Status"))
    ragged.write.option("header", True).option("quote", "\u0000").csv(f"{path}/ragged")
    rows = CSV.csv_upload_rows(spark, [f"{path}/{name}" for name in (*sheets, "ragged")], IMPORT_CONFIRM)
    cur = upload_to_current(rows, IMPORT_CONFIRM, F.lit("2030-01-01 00:00:00").cast("timestamp_ntz"))
    return cur.select("mawb", "status", "airline", "eta", "hawb_customer", "bot_status", "address")


@register("alias_rename", sql="""
SELECT CAST(o_orderkey AS VARCHAR) AS mawb, o_orderstatus AS status,
       CAST(o_custkey AS VARCHAR) AS airline,
       CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE 'C-' || CAST(o_custkey AS VARCHAR) END AS hawb_customer
FROM orders""")
def alias_rename(spark, sf_dir):
    """P2 on a wide frame: rename by alias, drop unknown, last alias wins."""
    o = table(spark, sf_dir, "orders")
    wide = o.select(F.col("o_orderkey").cast("string").alias("M#"),
                    F.col("o_orderstatus").alias(" Status "),
                    F.col("o_custkey").cast("string").alias("Airline"),
                    F.col("o_orderpriority").alias("Customer"),
                    F.when(F.col("o_orderpriority") == "5-LOW", F.lit(None).cast("string"))
                    .otherwise(F.concat(F.lit("C-"), F.col("o_custkey").cast("string"))).alias("HAWB Customer"),
                    F.col("o_totalprice").alias("Unknown Col"))
    return N.alias_rename(wide, IMPORT_CONFIRM)


@register("header_normalise", sql=f"SELECT p_partkey, lower({strip('p_type')}) AS header FROM part")
def header_normalise(spark, sf_dir):
    """Lower case then strip."""
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", N.header_normalise("p_type").alias("header"))


# -- S3/S4/S7/S8: JSON payloads built from events and line items ----------------

PAYLOAD_ROWS = 256  # records per bulk request


def _event_payloads(ev, record, wrap=None, rows=PAYLOAD_ROWS):
    """Events grouped into bulk requests of so many consecutive events;
    each request is bounded, whatever the key skew."""
    g = ev.groupBy((F.col("event_id") / F.lit(rows)).cast("bigint").alias("payload_id")).agg(
        F.array_sort(F.collect_list(F.struct("event_id", record.alias("j")))).alias("_r"))
    body = F.array_join(F.transform("_r", lambda r: r["j"]), ",\n    ")
    text = F.concat(F.lit("[\n    "), body, F.lit("\n  ]"))
    return g.select("payload_id", (wrap(text) if wrap else text).alias("payload"))


_BULK_SQL = """
SELECT event_id // 256 AS payload_id,
       CAST(row_number() OVER (PARTITION BY event_id // 256 ORDER BY event_id) - 1 AS INTEGER) AS pos,
       user_id, event_type, value, props
FROM events"""


def _bulk_record():
    return F.to_json(F.struct(F.col("user_id").cast("string").alias("user_id"),
                              "event_type", "value", "props"))


def _typed_rows(rows):
    f = F.col("fields")
    return rows.select("payload_id", "pos",
                       F.element_at(f, F.lit("user_id")).cast("bigint").alias("user_id"),
                       F.element_at(f, F.lit("event_type")).alias("event_type"),
                       F.element_at(f, F.lit("value")).cast("double").alias("value"),
                       F.element_at(f, F.lit("props")).alias("props"))


@register("json_scan", sql=_BULK_SQL)
def json_scan(spark, sf_dir):
    """S3: bulk request bodies (JSON arrays, schema-free rows as maps), one
    record per row with its position in the request."""
    ev = table(spark, sf_dir, "events")
    payloads = _event_payloads(ev, _bulk_record())
    return _typed_rows(J.explode_rows(payloads, "payload", "payload_id"))


@register("json_file_scan", sql=_BULK_SQL)
def json_file_scan(spark, sf_dir):
    """S3 over files: each bulk request written as its own JSON array file,
    read back whole-file (one task per file, files in parallel)."""
    ev = table(spark, sf_dir, "events")
    path = scratch_dir(spark, "json_scan")
    _event_payloads(ev, _bulk_record()).write.partitionBy("payload_id").text(path)
    rows = J.read_json_array_files(spark, path)
    rows = rows.withColumn("payload_id", F.regexp_extract("file_path", r"payload_id=(\d+)", 1).cast("bigint"))
    return _typed_rows(rows)


LARGE_ROWS = 65_536  # records per large array file


@register("json_split_scan", sql=_BULK_SQL.replace("256", str(LARGE_ROWS)))
def json_split_scan(spark, sf_dir):
    """S3 over large files: each array file is cut into splits, whose pieces
    find their place in the array by quote parity and depth."""
    ev = table(spark, sf_dir, "events")
    path = scratch_dir(spark, "json_split_scan")
    _event_payloads(ev, _bulk_record(), rows=LARGE_ROWS).write.partitionBy("payload_id").text(path)
    rows, _ = JR.read_json_arrays(spark, path)
    rows = rows.withColumn("payload_id", F.regexp_extract("file_path", r"payload_id=(\d+)", 1).cast("bigint"))
    return _typed_rows(rows.withColumn("pos", F.col("pos").cast("int")))


@register("embedded_json_scan", sql=_BULK_SQL)
def embedded_json_scan(spark, sf_dir):
    """The same arrays embedded as ``var EVENTS = [...];`` in a script
    text, sliced out by pattern and parsed."""
    ev = table(spark, sf_dir, "events")
    payloads = _event_payloads(ev, _bulk_record(), wrap=lambda t: F.concat(
        F.lit("(function (root) {\n  var OTHER = [];\n  var EVENTS = "), t,
        F.lit(";\n  root.DATA = EVENTS;\n})(this);\n")))
    rows = payloads.select("payload_id", F.posexplode(J.embedded_array("payload", "EVENTS")).alias("pos", "fields"))
    return _typed_rows(rows)


@register("nested_batch_scan", sql="""
SELECT event_id // 256 AS payload_id,
       CAST(row_number() OVER (PARTITION BY event_id // 256 ORDER BY event_id) - 1 AS INTEGER) AS pos,
       user_id,
       CASE WHEN event_type = 'click' THEN value END AS value,
       CASE WHEN event_type = 'view' THEN props END AS props
FROM events WHERE event_type IN ('click', 'view')""")
def nested_batch_scan(spark, sf_dir):
    """Write-back batches ``{items: [{mawb, result}]}``; NULL result fields
    are dropped."""
    ev = table(spark, sf_dir, "events").filter(F.col("event_type").isin("click", "view"))
    item = F.to_json(F.struct(
        F.col("user_id").cast("string").alias("mawb"),
        F.create_map(F.lit("value"), F.when(F.col("event_type") == "click", F.col("value").cast("string")),
                     F.lit("props"), F.when(F.col("event_type") == "view", F.col("props"))).alias("result")))
    payloads = _event_payloads(ev, item, wrap=lambda t: F.concat(F.lit('{"items": '), t, F.lit("}")))
    rows = J.explode_nested_batch(payloads, "payload", "payload_id")
    return rows.select("payload_id", "pos", F.col("key").cast("bigint").alias("user_id"),
                       F.element_at("result", F.lit("value")).cast("double").alias("value"),
                       F.element_at("result", F.lit("props")).alias("props"))


ORDERS_PER_BATCH = 1024


def _flat_payloads(li):
    """Milestone batches: per ship day, return flag and block of order keys,
    ``{mawbs, field, value}``; the N flag names a field that is refused."""
    g = li.groupBy(
        F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("value"),
        F.col("l_returnflag").alias("flag"),
        (F.col("l_orderkey") / F.lit(ORDERS_PER_BATCH)).cast("bigint").alias("block"),
    ).agg(F.array_sort(F.collect_set(F.concat(F.lit(" "), F.col("l_orderkey").cast("string")))).alias("mawbs"))
    field = F.when(F.col("flag") == "R", F.lit(" ATA ")).when(F.col("flag") == "A", F.lit("atd")).otherwise(F.lit("eta"))
    return g.select(F.concat_ws("/", "value", "flag", F.col("block").cast("string")).alias("payload_id"),
                    F.to_json(F.struct("mawbs", field.alias("field"), "value")).alias("payload"))


_FLAT_GROUPS_SQL = """
g AS (
  SELECT strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS value, l_returnflag AS flag,
         l_orderkey // 1024 AS block, ' ' || CAST(l_orderkey AS VARCHAR) AS k
  FROM lineitem GROUP BY ALL
)"""


@register("flat_batch_scan", sql=f"""WITH {_FLAT_GROUPS_SQL}
SELECT value || '/' || flag || '/' || CAST(block AS VARCHAR) AS payload_id,
       CAST(row_number() OVER (PARTITION BY value, flag, block ORDER BY k) - 1 AS INTEGER) AS pos,
       trim(k) AS mawb,
       CASE WHEN flag = 'R' THEN 'ata' ELSE 'atd' END AS field,
       value
FROM g WHERE flag IN ('R', 'A')""")
def flat_batch_scan(spark, sf_dir):
    """``{mawbs, field, value}`` batches to one patch per key; keys
    trimmed, field lower-cased, refused batches left out."""
    li = table(spark, sf_dir, "lineitem")
    rows = J.explode_flat_batch(_flat_payloads(li), "payload", "payload_id")
    return rows.select("payload_id", "pos", F.col("key").alias("mawb"),
                       F.map_keys("result")[0].alias("field"), F.map_values("result")[0].alias("value"))


@register("batch_validate", sql=f"""WITH {_FLAT_GROUPS_SQL}
SELECT DISTINCT value || '/' || flag || '/' || CAST(block AS VARCHAR) AS payload_id,
       CASE WHEN flag IN ('R', 'A') THEN NULL ELSE 'field must be ''atd'' or ''ata''' END AS reason
FROM g""")
def batch_validate(spark, sf_dir):
    """a batch with a bad field, no value or no keys is refused whole."""
    p = _flat_payloads(table(spark, sf_dir, "lineitem"))
    return p.select("payload_id", J.flat_batch_reject_reason(J.flat_batch("payload")).alias("reason"))


@register("unknown_columns", sql="""
SELECT event_id, 'no such column: debug_note' AS error
FROM events WHERE event_type = 'error'""")
def unknown_columns(spark, sf_dir):
    """a bulk row naming a column the table lacks fails alone."""
    ev = table(spark, sf_dir, "events")
    fields = F.when(F.col("event_type") == "error", F.create_map(
        F.lit("user_id"), F.col("user_id").cast("string"), F.lit("value"), F.lit(None).cast("string"),
        F.lit("debug_note"), F.col("props"))).otherwise(F.create_map(
            F.lit("user_id"), F.col("user_id").cast("string"), F.lit("value"), F.col("value").cast("string")))
    profile = TableProfile("events", "user_id", ("user_id", "value", "props"))
    ch, _ = C.bulk_changes(ev.select("event_id", "ts", fields.alias("fields")), profile,
                           F.col("event_id"), F.col("ts"))
    _valid, errors = C.unknown_column_split(ch, profile)
    return errors.select(F.col("seq").alias("event_id"), "error")


@register("key_reject", sql="""
SELECT o_orderkey,
       (o_orderpriority IN ('5-LOW', '4-NOT SPECIFIED', '3-MEDIUM')) AS key_missing
FROM orders""")
def key_reject(spark, sf_dir):
    """keys NULL, blank, 'nan' or 'None' after strip are rejected;
    'NaN' and padded real keys are kept."""
    o = table(spark, sf_dir, "orders")
    prio = F.col("o_orderpriority")
    key = (F.when(prio == "5-LOW", F.lit(None).cast("string"))
           .when(prio == "4-NOT SPECIFIED", F.lit(" nan "))
           .when(prio == "3-MEDIUM", F.lit("None\t"))
           .when(prio == "2-HIGH", F.lit("NaN"))
           .otherwise(F.concat(F.lit("  "), F.col("o_orderkey").cast("string"))))
    return o.select("o_orderkey", T.is_missing_key(key).alias("key_missing"))


# -- S5/J6/A12/P3/P4: HTML scan of grid pages over the orders --------------------

_GRID_ROWS = 100  # orders on a page
_GRID_LABELS = ("M#", "Status", "Dest Handing Office")


def grid_page_table(spark, sf_dir):
    """Grid pages over ``orders``: header with a filter widget, selection column
    and gutter; body rows; a frozen clone but on every third page; a stated total,
    wrong on every fifth page; list items and cells without end tags."""
    # Orders meet by page as they are; the markup, many times as large, is made there.
    cores, shuffle = default_parallelism(spark), int(spark.conf.get("spark.sql.shuffle.partitions"))
    o = (table(spark, sf_dir, "orders")
         .select(F.floor(F.col("o_orderkey") / _GRID_ROWS).alias("page_id"), "o_orderkey", "o_orderstatus", "o_orderpriority")
         .repartition(max(2 * cores, shuffle), "page_id"))
    td = '<td class="el-table__cell"><div class="cell">'
    row = lambda r: F.concat(
        F.lit('<tr class="el-table__row"><td class="el-table__cell"><input type="checkbox">' + td),
        r["o_orderkey"].cast("string"), F.lit("</div></td>" + td + "<span>&nbsp;"), r["o_orderstatus"],
        F.lit("</span>\n</div>" + td + "<ul><li>"), T.html_escape(F.concat(F.lit("<A> & "), r["o_orderpriority"])),
        F.lit("<li>\ufeff x\x85y</ul></div></tr>"))
    pages = (o.groupBy("page_id")  # at most _GRID_ROWS rows a group
             .agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus", "o_orderpriority"))).alias("_r"),
                  F.count(F.lit(1)).alias("n"))
             .select("page_id", F.array_join(F.transform("_r", row), "").alias("rows"), "n"))
    heads = "".join(f'<th><div class="cell"><span> {x} </span><ul><li>Option A<li>Option B</ul></div>' for x in _GRID_LABELS)
    head = ('<thead><tr><th class="el-table-column--selection"><div class="cell">x</div></th>' + heads
            + '<th class="gutter"></th></tr><tr><th>second</th></tr></thead>')
    body = F.concat(F.lit('<div class="el-table__body-wrapper"><table><tbody>'), "rows", F.lit("</tbody></table></div>"))
    clone = F.when(F.col("page_id") % 3 == 0, "").otherwise(F.concat(
        F.lit('<div class="el-table__fixed"><table>' + head + "<tbody>"), "rows", F.lit("</tbody></table></div>")))
    total = F.col("n") + F.when(F.col("page_id") % 5 == 0, 1).otherwise(0)
    return pages.select("page_id", F.concat(
        F.lit('<div class="el-table"><div class="el-table__header-wrapper"><table>' + head + "</table></div>"), body, clone,
        F.lit('</div><span class="el-pagination__total">Total '), total.cast("string"), F.lit(" rows</span>")).alias("html"))


_GRID_SQL = f"""
g AS (
  SELECT o_orderkey // {_GRID_ROWS} AS page_id,
         CAST(row_number() OVER (PARTITION BY o_orderkey // {_GRID_ROWS} ORDER BY o_orderkey) - 1 AS INTEGER) AS row_no,
         CAST(o_orderkey AS VARCHAR) AS k, o_orderstatus AS s,
         '<A> & ' || o_orderpriority || ' x' || chr(133) || 'y' AS p
  FROM orders
), n AS (
  SELECT page_id, count(*) AS n FROM g GROUP BY page_id
)"""


@register("html_grid_scan", sql=f"""WITH {_GRID_SQL}
SELECT page_id, row_no, 1 AS col_no, '{_GRID_LABELS[0]}' AS label, k AS value FROM g
UNION ALL SELECT page_id, row_no, 2, '{_GRID_LABELS[1]}', s FROM g
UNION ALL SELECT page_id, row_no, 3, '{_GRID_LABELS[2]}', p FROM g""")
def html_grid_scan(spark, sf_dir):
    """Body cells of every grid page; the clone's rows, the filter lists, the
    selection column and the gutter yield none."""
    return H.grid_cells(H.grid_scan(grid_page_table(spark, sf_dir), spread=False)).select(
        "page_id", "row_no", "col_no", "label", "value")


@register("count_reconcile", sql=f"""WITH {_GRID_SQL}
SELECT page_id, n AS extracted, n + CASE WHEN page_id % 5 = 0 THEN 1 ELSE 0 END AS reported,
       page_id % 5 <> 0 AS matches FROM n""")
def count_reconcile(spark, sf_dir):
    """Rows the scan extracted per page vs the total the page states."""
    return A.count_reconcile(H.grid_pages(H.grid_scan(grid_page_table(spark, sf_dir), spread=False)))


@register("copy_check", sql=f"""WITH {_GRID_SQL}
SELECT page_id, CAST(CASE WHEN page_id % 3 = 0 THEN n ELSE 2 * n END AS INTEGER) AS dom_rows,
       CAST(n AS INTEGER) AS body_rows, page_id % 3 <> 0 AS clone_doubles FROM n""")
def copy_check(spark, sf_dir):
    """All rows vs body rows per page; pages without a clone do not double."""
    return A.copy_check(H.grid_pages(H.grid_scan(grid_page_table(spark, sf_dir), spread=False)))


_CONV_ALIASES = {"user": "question", "assistant": "answer"}


def _conv_cells(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", F.col("turn").alias("col_no"), F.col("role").alias("label"),
                    F.col("text").alias("value"))


def _clean_sql(x: str) -> str:
    return f"CASE WHEN lower({strip(x)}) IN ('', 'nan', 'none', '-') THEN NULL ELSE {strip(x)} END"


@register("label_map", sql=f"""
WITH last AS (
  SELECT conv_id,
         arg_max_null(text, turn) FILTER (WHERE role = 'user') AS u,
         arg_max_null(text, turn) FILTER (WHERE role = 'assistant') AS a
  FROM conversations GROUP BY conv_id
), cl AS (
  SELECT conv_id, {_clean_sql('u')} AS question, {_clean_sql('a')} AS answer FROM last
)
SELECT conv_id, question, answer FROM cl WHERE question IS NOT NULL""")
def label_map(spark, sf_dir):
    """Long labelled cells to one record per row through an alias map;
    whole texts, stripped; null-like values dropped; rows need the key."""
    rows = N.label_map(_conv_cells(spark, sf_dir), _CONV_ALIASES, "question", row_cols=("conv_id",))
    return rows.select("conv_id", F.element_at("fields", F.lit("question")).alias("question"),
                       F.element_at("fields", F.lit("answer")).alias("answer"))


@register("unmapped_labels", sql="""
SELECT DISTINCT role AS label FROM conversations WHERE lower(trim(role)) NOT IN ('user', 'assistant')""")
def unmapped_labels(spark, sf_dir):
    """Labels with no alias, distinct, sorted."""
    return N.unmapped_labels(_conv_cells(spark, sf_dir), _CONV_ALIASES)


@register("rename_default", sql="""
SELECT event_id, COALESCE(json_extract_string(props, '$.k'), '') AS k_value,
       '' AS campaign FROM events""")
def rename_default(spark, sf_dir):
    """Source keys to columns, missing -> ''."""
    ev = table(spark, sf_dir, "events")
    m = F.from_json("props", "map<string,string>")
    return ev.select("event_id", *N.rename_default(m, {"k": "k_value", "campaign": "campaign"}))
