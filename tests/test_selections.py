"""Bitmaps, exact top-k, the gram index and the change feed against plain readings of them."""

import random
import re
import tempfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from shipfold.operators import aggregates as A
from shipfold.operators import bitmaps as BM
from shipfold.operators import change_feed as CF
from shipfold.operators import exact_topk as XK
from shipfold.operators import filters as FL
from shipfold.operators import gram_index as GI
from shipfold.operators import tables as TB


def _ids(df, col="id"):
    return sorted(r[col] for r in df.collect())


def test_bitmaps_are_the_predicates(spark):
    numbers = [-70000, -32768, -32767, -1, 0, 1, 2, 8, 9, 32768, 32769, 65536, 65537, (5 << 40) + 3]
    rows = [(n, i % 2 == 0, i % 3 == 0) for i, n in enumerate(numbers)] + [(None, True, True)]
    df = spark.createDataFrame(rows, "n bigint, a boolean, b boolean")
    maps = BM.selection_bitmaps(df, "n", {"a": F.col("a"), "b": F.col("b"), "none": F.lit(False)}).cache()
    a, b = {r[0] for r in rows[:-1] if r[1]}, {r[0] for r in rows[:-1] if r[2]}
    parts = {"any": (BM.united(maps, ["a", "b"], "any"), a | b), "all": (BM.common(maps, ["a", "b"], "all"), a & b),
             "a": (maps.filter("selection = 'a'"), a), "none": (BM.common(maps, ["a", "none"], "none"), set())}
    for part, want in parts.values():
        assert _ids(BM.row_numbers(part), "row_number") == sorted(want)
        assert _ids(BM.selected_rows(df, "n", part), "n") == sorted(want)
        assert [r.row_count for r in BM.row_counts(part).collect()] == ([len(want)] if want else [])
    assert BM.selected_rows(df, "n", parts["a"][0]).columns == df.columns


@pytest.mark.parametrize("shape", ["hot", "flat", "ties", "few", "empty"])
def test_exact_top_k_for_any_sketch_and_buckets(spark, shape):
    rng = random.Random(3)
    values = {"hot": ["hot"] * 900 + [f"v{rng.randrange(400)}" for _ in range(2000)], "flat": [f"v{i}" for i in range(900)],
              "ties": [f"v{i % 90:02}" for i in range(900)], "few": ["b", "a", "b", None], "empty": []}[shape]
    df = spark.createDataFrame([(v,) for v in [*values, None, None]], "c string").repartition(5)
    count = Counter(v for v in values if v is not None)
    want = sorted(count.items(), key=lambda x: (-x[1], x[0]))[:10]
    # A sketch of eight values is wrong nearly everywhere; three buckets settle nothing.
    for tracked, buckets in ((8192, 1 << 16), (8, 64), (8, 3)):
        got = XK.exact_top_k(df, "c", tracked=tracked, buckets=buckets)
        assert [tuple(r) for r in got.collect()] == want, (tracked, buckets)
    assert [tuple(r) for r in A.top_k(df, "c").collect()] == want


def test_exact_top_k_settles_the_tail_of_a_skewed_column(spark):
    values = [f"h{i}" for i in range(20) for _ in range(200 + i)] + [f"t{i}" for i in range(3000)]
    rows = spark.createDataFrame([(v,) for v in values], "v string")
    counted = XK.candidate_counts(rows, XK.TRACKED, XK.BUCKETS).collect()
    assert sum(r.cnt for r in counted) == len(values)
    sure = sorted((r.cnt for r in counted if r.label is not None), reverse=True)
    assert sure[9] == 210 and max((r.cnt for r in counted if r.bucket is not None), default=0) < 210


def _like(value, text):
    low = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s)
    pattern = "".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in low(value))
    return text is not None and re.search(pattern, low(text), re.S) is not None


def test_gram_search_is_the_filter(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("abAB É%_\\\nc") for _ in range(rng.randrange(12))) for _ in range(400)]
    texts += [None, "", "ab", "x" * 50_000 + "Needle" + "y" * 50_000, "ab\U0001f600cd", "İstanbul K KELVIN", "ΟΔΟΣ", "ΟΔΟΣ abc"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").repartition(3)
    like, lower = tempfile.mkdtemp() + "/like", tempfile.mkdtemp() + "/lower"
    GI.write_gram_index(df, "id", "t", like)
    GI.write_gram_index(df, "id", "t", lower, F.lower)
    for value in ("abc", "ABc", "a_bca", "ab%abc", "%_%", "ab", "É", "éab", "Éab", "\\abc", "b\\a", "needle", "b\U0001f600c", "zzz",
                  "%needle%y", "_______________", "a%%b"):
        got = GI.search_like(df, "id", "t", value, like)
        assert _ids(got) == [i for i, t in enumerate(texts) if _like(value, t)], value
        assert got.columns == df.columns
    for value in ("abc", "ABÉ", "éab", "%_\\", "İsta", "i̇st", "k kel", "οδος", "needle", "zzz", "b%"):
        assert _ids(GI.search_contains(df, "id", "t", value, lower)) == _ids(FL.contains_filter(df, "t", value)), value
    assert GI.search_like(df, "id", "t", None, like).count() == len(texts)


def test_gram_search_reads_the_patterns_postings_alone(spark):
    df = spark.range(2000).select("id", F.concat(F.lit("row number "), F.col("id").cast("string")).alias("t"))
    root = tempfile.mkdtemp() + "/i"
    GI.write_gram_index(df, "id", "t", root)
    found = GI.candidates(df, "id", root, ["row", "199", "r 1"])
    assert "PushedFilters: [In(gram" in found._jdf.queryExecution().toString()
    assert _ids(found) == [i for i in range(2000) if "199" in str(i) and str(i)[0] == "1"]
    empty = tempfile.mkdtemp() + "/e"
    GI.write_gram_index(df.limit(0), "id", "t", empty)
    assert GI.search_like(df.limit(0), "id", "t", "row", empty).count() == 0


def test_change_feed_turns_one_version_into_the_next(spark):
    cols, rng = ["a", "b"], random.Random(8)
    cell = lambda: rng.choice([None, "", "x", "y", "null", '"x"', "x,y"])
    was = {f"k{i}": (cell(), cell()) for i in range(60)}
    now = {k: v if rng.random() < 0.5 else (cell(), cell()) for k, v in was.items() if rng.random() < 0.8}
    now |= {f"n{i}": (cell(), cell()) for i in range(15)}
    was[None], now[None] = ("x", ""), ("x", None)
    frame = lambda d: spark.createDataFrame([(k, *v) for k, v in d.items()], "key string, a string, b string")
    old, new = frame(was), frame(now)
    want = {k: "inserted" if k not in was else "deleted" if k not in now else "unchanged" if was[k] == now[k] else "updated"
            for k in was | now}
    assert {r.key: r.change for r in CF.version_changes(old, new, "key", cols).collect()} == want
    feed, table = CF.change_feed(old, new, "key", cols).collect(), dict(was)
    assert len(feed) == sum(v != "unchanged" for v in want.values())
    for r in feed:
        if r.change == "deleted":
            del table[r.key]
        else:
            table[r.key] = (r.a, r.b)
    assert table == now
    assert CF.change_feed(old, old, "key", cols).count() == 0
    assert {r.change for r in CF.version_changes(old.limit(0), new, "key", cols).collect()} == {"inserted"}


def test_committed_versions_are_read_by_number(spark):
    root = tempfile.mkdtemp()
    for v in (1, 2):
        TB.publish_snapshot(spark, spark.createDataFrame([(v,)], "x int"), root, v)
    spark.createDataFrame([(3,)], "x int").write.parquet(f"{root}/data/version=3")  # never committed
    assert [TB.read_snapshot(spark, root, v).first()[0] for v in (1, 2, None)] == [1, 2, 2]
    with pytest.raises(FileNotFoundError):
        TB.read_snapshot(spark, root, 3)
