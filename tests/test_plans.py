"""Physical plan checks: the plans we want, not just the right rows."""

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
# Queries that write files before returning (their plans read what was written).
WRITERS = {"csv_scan", "stream_fold", "reset_report", "seed_if_empty", "snapshot_publish",
           "json_file_scan"}
PYTHON_OK = {"html_grid_scan", "count_reconcile", "copy_check"}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - WRITERS))
def test_no_cross_products_or_row_udfs(spark, name):
    plan = _plan(entry.queries()[name](spark, SF))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert bad not in plan, bad
    if name not in PYTHON_OK:
        assert "MapInPandas" not in plan


def test_page_is_top_k(spark):
    plan = _plan(entry.queries()["page_desc"](spark, SF))
    assert "TakeOrderedAndProject" in plan and "Exchange rangepartitioning" not in plan


def test_equality_reaches_parquet(spark):
    plan = _plan(entry.queries()["eq_filter"](spark, SF))
    pushed = plan[plan.index("PushedFilters"):]
    assert "EqualTo(o_orderstatus,F)" in pushed  # status = 'F' simplified through the CASE


def test_facet_report_shares_one_exchange(spark):
    df = entry.queries()["facet_report"](spark, SF)
    df.collect()
    final = _plan(df).split("Initial Plan")[0]
    assert final.count("ReusedExchange") == 4
    assert final.count("FileScan") == 1


def test_csv_upload_parses_the_data_once(spark, tmp_path):
    # Two CSV scans: one that parses no column (line counts per split) and
    # the main scan. Headers come from the small text-pass table, so no
    # second full parse of the data.
    import re

    from shipfold.profiles import IMPORT_CONFIRM
    from shipfold.sources import csv as CSV
    for i in range(3):
        (tmp_path / f"u{i}.csv").write_text("M#,ETA\n" + "".join(f"{i}-{j},x\n" for j in range(50)))
    plan = _plan(CSV.csv_upload_rows(spark, [str(tmp_path)], IMPORT_CONFIRM))
    schemas = re.findall(r"FileScan csv .*?ReadSchema: (struct<[^>]*>)", plan)
    assert sorted(schemas) == ["struct<>", "struct<_c0:string,_c1:string>"], schemas
