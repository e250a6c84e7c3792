"""Smaller helpers: keyset paging, the JSON envelope, JSON file readers,
missing-key split, change fingerprints."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from shipfold.operators import filters as FL
from shipfold.operators import paging as P
from shipfold.sources import json as J


def test_keyset_page_and_envelope(spark):
    df = spark.range(0, 120).select(F.col("id").alias("row_seq"), F.col("id").cast("string").alias("k"))
    first = P.page_desc(df, "row_seq", 1, 50).collect()
    nxt = P.page_after(df, "row_seq", first[-1]["row_seq"], 50).collect()
    assert [r["row_seq"] for r in nxt] == [r["row_seq"] for r in P.page_desc(df, "row_seq", 2, 50).collect()]
    env = json.loads(P.envelope_json(df, "row_seq", 3, 50).first()[0])
    assert (env["total"], env["page"], env["pages"], len(env["items"])) == (120, 3, 3, 20)
    assert env["items"][0]["row_seq"] == 19


def test_json_file_readers(spark):
    tmp = tempfile.mkdtemp()
    with open(os.path.join(tmp, "a.json"), "w") as fh:
        json.dump([{"mawb": "1", "eta": None}, {"mawb": "2", "wt": 3.5}], fh, indent=2)
    rows = J.read_json_array_files(spark, os.path.join(tmp, "a.json")).orderBy("pos").collect()
    assert [r["fields"] for r in rows] == [{"mawb": "1", "eta": None}, {"mawb": "2", "wt": "3.5"}]
    with open(os.path.join(tmp, "b.jsonl"), "w") as fh:
        fh.write('{"mawb": "3"}\n{"mawb": "4", "status": null}\n')
    lines = J.read_json_lines(spark, os.path.join(tmp, "b.jsonl")).collect()
    assert sorted(r["fields"]["mawb"] for r in lines) == ["3", "4"]


def test_split_missing_key(spark):
    df = spark.createDataFrame([(" 900-1 ",), ("nan",), (None,), ("NaN",), (" None",)], "k string")
    kept, rejected = FL.split_missing_key(df, "k")
    assert sorted(r["k"] for r in kept.collect()) == ["900-1", "NaN"]
    assert rejected.count() == 3
    flagged = FL.flag_missing_key(df, "k").filter("key_missing").count()
    assert flagged == 3


def test_pages_tile_the_table_at_every_offset(spark):
    """Pages in a row are the whole order, rows without an order value last."""
    df = spark.range(0, 500).select(F.when(F.col("id") >= 3, F.col("id") * 7 % 503).alias("row_seq"), F.col("id"))
    whole = [r["row_seq"] for r in df.orderBy(F.col("row_seq").desc()).collect()]
    got = [r["row_seq"] for page in range(1, 12) for r in P.page_desc(df, "row_seq", page, 50).collect()]
    assert got == whole and got[-3:] == [None] * 3


def test_join_checked_bounds_rows_and_bytes(spark):
    from shipfold.operators.joins import join_checked
    big = spark.range(1000).withColumnRenamed("id", "k")
    small = spark.range(10).withColumnRenamed("id", "k")

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    # Spark's own size-based broadcast is off, so only the hint can broadcast.
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for k in keys:
        spark.conf.set(k, "-1")
    try:
        assert "BroadcastExchange" in plan(join_checked(big, small, "k", row_bound=10, row_bytes=100))
        # Ten rows, but each may be 10 MB: 100 MB is over the byte bound.
        wide = join_checked(big, small, "k", row_bound=10, row_bytes=10 * 1024 * 1024)
        assert "BroadcastExchange" not in plan(wide)
        assert wide.count() == 10
    finally:
        for k in keys:
            spark.conf.unset(k)


def test_dense_positions_keep_order_and_stay_small(spark):
    from shipfold.operators.changes import dense_positions
    # One rule for few partitions and many: partition order, then row order.
    for parts in (4, 300):
        df = spark.range(0, 3000, numPartitions=parts)
        rows = dense_positions(df, "pos").orderBy("id").collect()
        pos = [r["pos"] for r in rows]
        assert pos == sorted(pos) and len(set(pos)) == 3000
        assert pos == list(range(3000))
        assert max(pos) < 1 << 40


def test_newest_partition_from_listing(spark):
    from shipfold.operators.tables import newest_partition
    root = os.path.join(tempfile.mkdtemp(), "log")
    assert newest_partition(spark, root, "batch") is None  # no folder yet
    for b in (2, 10, 9):
        spark.range(3).write.mode("overwrite").parquet(f"{root}/batch={b}")
    assert newest_partition(spark, root, "batch") == 10  # numeric, not text order
