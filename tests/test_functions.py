"""Scalar functions and filters on invented values."""

import datetime as dt

from pyspark.sql import functions as F

from shipfold.functions import milestone as M
from shipfold.functions import text as T
from shipfold.operators import aggregates as A
from shipfold.operators import filters as FL
from shipfold.operators import paging as P

NOW = dt.datetime(2030, 1, 10, 12, 0, 0)


def test_time_rule_edges(spark):
    cases = [
        ("2030-01-10", "09:00", "3-Hour Rule (use actual time directly)", "2030-01-10 09:00:00"),
        ("2030-01-10", "08:59", "2.5-Hour Rollback (now - 2.5h)", "2030-01-10 09:30:00"),
        ("2030-01-11", "12:00", "3-Hour Rule (use actual time directly)", "2030-01-11 12:00:00"),
        ("2030-01-11", "12:01", "Scheduled (actual not yet reached)", "2030-01-11 12:01:00"),
        ("2030-13-40", "10:00", None, None),
        ("", "10:00", None, None),
    ]
    df = spark.createDataFrame([(d, t) for d, t, _, _ in cases], "d string, t string")
    got = df.select(M.time_rule("d", "t", F.lit(NOW).cast("timestamp_ntz")).alias("r")).collect()
    for (d, t, rule, value), row in zip(cases, got):
        r = row["r"]
        assert (r["rule"] if r else None, r["value"] if r else None) == (rule, value), (d, t)


def test_status_tags_and_parts(spark):
    df = spark.createDataFrame([
        ("", "2030-01-01 10:00:00", "A, B,", "x"), (None, None, "", None), ("t", "", "  C  ", "y")],
        "atd string, ata string, tags string, eta string")
    r = df.select(M.milestone_status("atd", "ata").alias("s"), T.tag_split("tags").alias("t"),
                  M.captured_seed("ata", "eta").alias("seed")).collect()
    assert [x["s"] for x in r] == ["Completed", "Pending Depart", "Pending Arrival"]
    assert [x["t"] for x in r] == [["A", "B", ""], [], ["C"]]
    assert [x["seed"] for x in r] == ["2030-01-01 10:00:00", "", "y"]
    p = spark.createDataFrame([("2030-01-01 10:05:30",), ("",)], "s string").select(
        M.date_part("s").alias("d"), M.time_part("s").alias("t")).collect()
    assert [(x["d"], x["t"]) for x in p] == [("2030-01-01", "10:05"), ("", "")]


def test_text_helpers(spark):
    df = spark.createDataFrame([("\t a  b \n", 'x<&>"', "Total 25 rows"), (None, None, "none")],
                               "a string, b string, c string")
    r = df.select(T.collapse_ws("a").alias("c"), T.strip("a").alias("s"), T.html_escape("b").alias("e"),
                  T.first_int("c").alias("n")).collect()
    assert (r[0]["c"], r[0]["s"], r[0]["e"], r[0]["n"]) == ("a b", "a  b", "x&lt;&amp;&gt;&quot;", 25)
    assert (r[1]["e"], r[1]["n"]) == ("", None)
    m = spark.createDataFrame([({"b": "2", "a": None},)], "m map<string,string>")
    assert m.select(T.canonical_key("m")).first()[0] == '[["a",null],["b","2"]]'


def test_filters(spark):
    df = spark.createDataFrame([
        ("a", "Not Existing", "2030-01-05 08:00:00", "50%_off"), ("b", "Existing", "", "x"),
        ("c", None, "2030-01-06 23:59:00", "5_"), ], "k string, m string, eta string, t string")
    ks = lambda d: sorted(r["k"] for r in d.collect())
    assert ks(FL.select_filter(df, "m", "existing")) == ["a", "b"]
    assert ks(FL.select_filter(df, "m", "Existing", exact=True)) == ["b"]
    assert ks(FL.date_range_filter(df, "eta", "2030-01-05", None)) == ["a", "c"]
    assert ks(FL.date_range_filter(df, "eta", None, "2030-01-05")) == ["a", "b"]
    assert ks(FL.date_range_filter(df, "eta", "2030-01-06", "2030-01-06")) == ["c"]
    assert ks(FL.like_filter(df, "t", "5_")) == ["a", "c"]
    assert ks(FL.contains_filter(df, "t", "%")) == ["a"]
    assert ks(FL.grid_filter(df, {"m": " All ", "eta": {"start": "", "end": ""}, "t": " "})) == ["a", "b", "c"]
    assert ks(FL.sentinel_filter(df, {"k": "All", "m": "Existing"})) == ["b"]


def test_paging_and_facets(spark):
    df = spark.range(0, 7).select(F.col("id").alias("row_seq"),
                                  F.when(F.col("id") < 2, F.lit(None)).when(F.col("id") < 4, F.lit(""))
                                  .otherwise(F.lit("Unknown")).alias("status"))
    assert [r[0] for r in P.page_desc(df, "row_seq", 2, 3).collect()] == [3, 2, 1]
    assert P.page_desc(df, "row_seq", 5, 3).count() == 0
    env = P.page_envelope(df.filter("row_seq > 100"), 1, 50).first()
    assert (env["total"], env["pages"]) == (0, 1)
    fac = {r["label"]: r["cnt"] for r in A.facet_status(df).collect()}
    assert fac == {"Unknown": 7}
    ties = spark.createDataFrame([(f"c{i:02d}",) for i in range(12)] + [("c05",)], "a string")
    top = A.top_k(ties, "a", 10).collect()
    assert [r["label"] for r in top] == ["c05"] + [f"c{i:02d}" for i in range(10) if i != 5]


def test_browser_and_python_white_space(spark):
    """Collapse and tags use the browser's set: U+FEFF goes, U+0085 and U+001C stay; strip uses Python's."""
    from shipfold.functions import text as T
    df = spark.createDataFrame([("\ufeff a\x85\x1cb \u00a0c\x1c",)], "a string")
    r = df.select(T.collapse_ws("a").alias("c"), T.strip("a").alias("s"), T.tag_split("a").alias("t")).first()
    assert r.c == "a\x85\x1cb c\x1c" and r.t == ["a\x85\x1cb \u00a0c\x1c"]
    assert r.s == "\ufeff a\x85\x1cb \u00a0c" == "\ufeff a\x85\x1cb \u00a0c\x1c".strip()


def test_browser_white_space_pattern_is_the_listed_set(spark):
    """Every code point but the surrogates, once."""
    from shipfold.functions.text import BROWSER_RUN_RE, BROWSER_WS_CHARS
    points = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    text = spark.createDataFrame([("".join(map(chr, points[i:i + 4096])),) for i in range(0, len(points), 4096)], "t string")
    found = text.select(F.explode(F.regexp_extract_all("t", F.lit(BROWSER_RUN_RE), F.lit(0))).alias("run")).collect()
    assert sorted("".join(r.run for r in found)) == sorted(BROWSER_WS_CHARS)
