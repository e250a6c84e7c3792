"""SQL functions equal their Column twins on the driver tables (whole texts)."""

from pyspark.sql import functions as F

from shipfold.functions import milestone as M
from shipfold.functions import text as T
from shipfold.functions.sql import register_sql_functions

SF = "/root/testdata/sf0.001"


def _same(df, sql_expr, col_expr):
    bad = df.filter(~F.expr(sql_expr).eqNullSafe(col_expr)).count()
    assert bad == 0, sql_expr


def test_sql_functions_match_columns(spark):
    register_sql_functions(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    _same(docs, "sf_collapse_ws(text)", T.collapse_ws("text"))
    _same(docs, "sf_strip(text)", T.strip("text"))
    _same(docs, "sf_html_escape(text)", T.html_escape("text"))
    _same(docs, "sf_tag_split(text)", T.tag_split("text"))
    _same(docs, "sf_clean_bulk(source)", T.token_clean_bulk("source"))
    _same(docs, "sf_clean_scrape(lang)", T.token_clean_scrape("lang"))
    _same(docs, "sf_is_missing_key(lang)", T.is_missing_key("lang"))
    _same(docs, "sf_contains(text, 'The')", F.contains(F.lower(F.coalesce("text", F.lit(""))), F.lit("the")))
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    _same(pages, "sf_first_int(url)", T.first_int("url"))
    ev = spark.read.parquet(f"{SF}/events.parquet")
    now = F.lit("2024-01-15 12:00:00").cast("timestamp_ntz")
    _same(ev, "sf_time_rule(date_trunc('minute', ts), TIMESTAMP_NTZ'2024-01-15 12:00:00')",
          M.time_rule_ts(F.date_trunc("minute", "ts").cast("timestamp_ntz"), now))
    odd = spark.createDataFrame([("", "x"), (None, None), ("a", ""), (" None ", " - ")], "a string, b string")
    _same(odd, "sf_milestone_status(a, b)", M.milestone_status("a", "b"))
    _same(odd, "sf_blank_default(a, 'New')", T.blank_default("a", "New"))
    _same(odd, "sf_is_missing_key(a)", T.is_missing_key("a"))
    _same(odd, "sf_clean_scrape(b)", T.token_clean_scrape("b"))
    _same(odd, "sf_in_range(a, 'a', '')", F.coalesce(F.col("a"), F.lit("")) >= "a")
    dates = spark.createDataFrame([("2030-01-05 08:00:00",), ("2030-01-05~",), ("2030-01-06 00:00:00",),
                                   ("",), (None,)], "d string")
    from shipfold.operators.filters import date_range_predicate
    for lo, hi in (("2030-01-05", "2030-01-05"), ("", "2030-01-05"), ("2030-01-05", "")):
        _same(dates, f"sf_in_range(d, '{lo}', '{hi}')", date_range_predicate("d", lo, hi))
