"""HTML grid scan on generated grid markup (invented rows)."""

from shipfold.operators import aggregates as A
from shipfold.operators import normalise as N
from shipfold.profiles import SCRAPE_LABEL_ALIASES
from shipfold.sources import html_grid as H

LABELS = ["Status", "M#", "Tags", "Dest Handing Office", "  ETA  "]


def _header(labels):
    ths = ['<th class="el-table-column--selection"><div class="cell"><label>x</label></div></th>']
    for lb in labels:
        ths.append(f'<th><div class="cell"><span>{lb}</span><div class="flt">'
                   f'<ul><li>Option A</li><li>Option B</li></ul></div></div></th>')
    ths.append('<th class="gutter"></th>')
    return "<thead><tr>" + "".join(ths) + "</tr><tr><th>second row</th></tr></thead>"


def _row(vals, hidden=False):
    tds = ['<td class="el-table__cell"><div class="cell"><input type="checkbox"></div></td>']
    for v in vals:
        cls = "el-table__cell is-hidden" if hidden else "el-table__cell"
        tds.append(f'<td class="{cls}"><div class="cell">{v}</div></td>')
    return '<tr class="el-table__row">' + "".join(tds) + "</tr>"


def grid_page(rows, total):
    body = "".join(_row(r) for r in rows)
    clone = "".join(_row(r, hidden=True) for r in rows)
    return ('<div class="el-table"><div class="el-table__header-wrapper"><table>' + _header(LABELS)
            + '</table></div><div class="el-table__body-wrapper"><table><tbody>' + body
            + '</tbody></table></div><div class="el-table__fixed"><div class="el-table__fixed-header-wrapper">'
            + "<table>" + _header(LABELS) + '</table></div><div class="el-table__fixed-body-wrapper">'
            + "<table><tbody>" + clone + "</tbody></table></div></div></div>"
            + f'<span class="el-pagination__total">Total {total}</span>')


ROWS = [
    ["New", "900-0000001", '<span class="el-tag">A</span>, <span class="el-tag">B C</span>', "Office &amp; Co", "2030-01-05  08:00:00"],
    ["-", "900-0000002", "", "x", "None"],
    ["Partial", "", "", "", ""],
]


def test_grid_scan_rows_labels_and_clone(spark):
    pages = spark.createDataFrame([(1, grid_page(ROWS, 3)), (2, grid_page([], 0)), (3, "<p>none</p>")],
                                  "page_id long, html string")
    scan = H.grid_scan(pages)
    cells = H.grid_cells(scan).orderBy("page_id", "row_no", "col_no").collect()
    assert len(cells) == 3 * 5
    first = {c["label"]: c["value"] for c in cells if c["row_no"] == 0}
    assert first == {"Status": "New", "M#": "900-0000001", "Tags": "A, B C",
                     "Dest Handing Office": "Office & Co", "ETA": "2030-01-05 08:00:00"}
    pg = {r["page_id"]: r for r in H.grid_pages(scan).collect()}
    assert (pg[1]["dom_rows"], pg[1]["body_rows"], pg[1]["reported_total"]) == (6, 3, "Total 3")
    assert (pg[2]["dom_rows"], pg[2]["body_rows"]) == (0, 0)
    checks = {r["page_id"]: r["clone_doubles"] for r in A.copy_check(H.grid_pages(scan)).collect()}
    assert checks[1] is True


def test_grid_to_fields(spark):
    pages = spark.createDataFrame([(1, grid_page(ROWS, 3))], "page_id long, html string")
    cells = H.grid_cells(H.grid_scan(pages))
    rows = N.label_map(cells, SCRAPE_LABEL_ALIASES, "mawb").orderBy("row_no").collect()
    assert len(rows) == 2  # the row without a key is dropped
    assert rows[0]["fields"]["dest_handling_office"] == "Office & Co"
    assert "status" not in rows[1]["fields"] and "eta" not in rows[1]["fields"]
    assert [r[0] for r in N.unmapped_labels(cells, SCRAPE_LABEL_ALIASES).collect()] == []


def test_full_grid_golden_counts(spark):
    """25 rows: 50 rows in the DOM (body + frozen clone), 25 in the body, 29
    header cells (selection + 28 labels) plus the gutter, reported total 25,
    every label mapped, including the grid's misspelt office label."""
    from shipfold.profiles import IMPORT_CONFIRM_GRID
    labels = [label for _c, label, _k, _o in IMPORT_CONFIRM_GRID]
    global LABELS
    saved, LABELS = LABELS, labels
    try:
        rows = [[f"V{r}-{c}" if c != 6 else f"900-{r:07d}" for c in range(len(labels))] for r in range(25)]
        html = grid_page(rows, 25)
    finally:
        LABELS = saved
    pages = spark.createDataFrame([(7, html)], "page_id long, html string")
    scan = H.grid_scan(pages)
    pg = H.grid_pages(scan).first()
    assert (pg["dom_rows"], pg["body_rows"], pg["reported_total"]) == (50, 25, "Total 25")
    cells = H.grid_cells(scan)
    assert cells.count() == 25 * 28
    assert cells.select("label").distinct().count() == 28
    mapped = N.label_map(cells, SCRAPE_LABEL_ALIASES, "mawb")
    assert mapped.count() == 25
    assert len(mapped.first()["fields"]) == 28
    assert N.unmapped_labels(cells, SCRAPE_LABEL_ALIASES).count() == 0


def test_deep_and_unclosed_markup(spark):
    """Neither nesting depth nor missing end tags fail a page or cost more than its length."""
    deep = "<div>" * 30_000 + grid_page(ROWS, 3)
    unclosed = "<ul>" + "<li>x" * 20_000 + "</ul>" + grid_page(ROWS, 3)
    pages = spark.createDataFrame([(1, deep), (2, unclosed), (3, "</div>" * 20_000 + "<div>" * 20_000), (4, None), (5, "")],
                                  "page_id long, html string")
    scan = H.grid_scan(pages)
    got = {r["page_id"]: (r["dom_rows"], r["body_rows"]) for r in H.grid_pages(scan).collect()}
    assert got == {1: (6, 3), 2: (6, 3), 3: (0, 0), 4: (0, 0), 5: (0, 0)}


def test_optional_end_tags_are_implied():
    html = ('<div class="el-table"><div class="el-table__header-wrapper"><table><thead><tr><th><div class=cell>A</div>'
            '<th><div class=cell>B</div><th class=gutter></table></div><div class="el-table__body-wrapper"><table><tbody>'
            '<tr class="el-table__row"><td class="el-table__cell">1<td class="el-table__cell"><ul><li>x<li>y</ul>'
            '<tr class="el-table__row"><td class="el-table__cell"><div class="cell">2</div> after<td class="el-table__cell">z')
    cells = [(r[2], r[4], r[5]) for r in H.extract_grid(1, html) if r[1] == "cell"]
    assert cells == [(0, "A", "1"), (0, "B", "x y"), (1, "A", "2"), (1, "B", "z")]


def test_text_has_the_browsers_white_space():
    assert H.collapse("\ufeff a\x85b \u2003\x1cc\n") == "a\x85b \x1cc"


def test_grid_path_end_to_end(spark):
    """Pages, grid scan, label map, bulk changes, fold; the counts agree where the page's total does."""
    from pyspark.sql import functions as F
    from shipfold.operators import changes as C
    from shipfold.operators import fold as FO
    from shipfold.plans.queries_sources import grid_page_table
    from shipfold.profiles import IMPORT_CONFIRM
    scan = H.grid_scan(grid_page_table(spark, "/root/testdata/sf0.001"))
    cells = H.grid_cells(scan)
    rows = N.label_map(cells, SCRAPE_LABEL_ALIASES, "mawb")
    ch, rejected = C.bulk_changes(rows, IMPORT_CONFIRM, F.struct("page_id", "row_no"), F.lit("2030-01-01 00:00:00"))
    assert rejected.count() == 0
    current = FO.fold_current(ch, IMPORT_CONFIRM) if hasattr(FO, "fold_current") else ch
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").count()
    assert current.count() == orders
    counts = A.count_reconcile(H.grid_pages(scan))
    assert counts.agg(F.sum("extracted")).first()[0] == orders
    assert {(r.page_id % 5 != 0) == r.matches for r in counts.collect()} == {True}


def test_grid_markup_in_odd_places():
    """Tags in attribute values, comments and scripts are none; a tag that the page cuts off is no text."""
    head = ('<div class=el-table><div class="el-table__header-wrapper"><table><thead><tr><th><div class=cell>M#</div></th>'
            '</tr></thead></table></div><div class="el-table__body-wrapper"><table><tbody>')
    row = '<tr class="el-table__row"><TD title="a > b class=\'cell\'" data-class="x" CLASS=\'el-table__cell y\'>{}</td></tr>'
    cells = ['1<!-- <td class="el-table__cell">no</td> -->', '<div class="cell">2 &lt;b&gt; &amp; 3 < 4</div>tail',
             'a<script>var t = "</td><tr>";</script>b', 'x<br/>y', '<b title="<td>">z</b>']
    page = head + "".join(row.format(c) for c in cells) + "</tbody></table></div></div><td cl"
    got = [r[5] for r in H.extract_grid(1, page) if r[1] == "cell"]
    assert got == ["1", "2 <b> & 3 < 4", 'avar t = "</td><tr>";b', "x y", "z"]
    cut = H.extract_grid(1, page[:page.index("2 &lt;")] + "2</di")
    assert [r[5] for r in cut if r[1] == "cell"] == ["1", "2"]


def test_scan_holds_one_page_of_a_batch_as_text(monkeypatch):
    """A batch of large pages stays as Arrow holds it; beside it only one page is a Python text, and
    the output waits for few pages."""
    import tracemalloc

    import pyarrow as pa
    page = grid_page([["一" * 20_000] * 2], 1)  # two bytes a character as a Python text
    batch = pa.RecordBatch.from_arrays([pa.array(range(200), pa.int64()), pa.array([page] * 200)], ["page_id", "html"])
    scan, rows = H._scanner(), 0
    monkeypatch.setattr(H, "OUT_CHARS", 1 << 20)
    H.extract_grid(1, page)
    tracemalloc.start()
    try:
        for out in scan(iter([batch])):
            rows += out.filter(pa.compute.equal(out["kind"], "page")).num_rows
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows == 200 and peak < 16 << 20 < 200 * 2 * len(page)


def test_pages_of_a_query_meet_as_orders_and_are_counted_by_no_extra_shuffle(spark):
    """The markup is made behind the shuffle, whose map side runs in the query alone."""
    from shipfold.plans.queries_sources import copy_check, count_reconcile, html_grid_scan
    for query in (html_grid_scan, count_reconcile, copy_check):
        tracker = spark.sparkContext.statusTracker()
        spark.sparkContext.setJobGroup(f"plan {query.__name__}", "")
        try:
            df = query(spark, "/root/testdata/sf0.001")
            # Reading a table's schema is a job of one task; a shuffle's map side is one more.
            assert len(tracker.getJobIdsForGroup(f"plan {query.__name__}")) <= 1
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "MapInPandas" not in plan
        below = plan[plan.index("Exchange hashpartitioning"):]
        assert "el-table__row" not in below


def test_long_pages_and_raw_text_read_alike(monkeypatch):
    """Pages cut at once and tag by tag give the same rows."""
    page = grid_page([["a<script>x</td></script>b", "<title>&lt;c</title>", "<b title='>'>d</b>"], ["e &amp; f", "g<br>h", "<p>i"]], 2)
    plain = page.replace("script", "span").replace("title", "div")
    got = [H.extract_grid(1, p) for p in (page, plain)]
    assert [r[5] for r in got[0] if r[6]][:3] == ["ax</td>b", "<c", "d"]
    monkeypatch.setattr(H, "_SPLIT_CHARS", 0)
    assert [H.extract_grid(1, p) for p in (page, plain)] == got
