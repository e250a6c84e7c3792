"""Streaming fold = one-shot fold for any split of the log; snapshot store."""

import datetime as dt
import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from shipfold.operators import fold as FO
from shipfold.operators import normalise as N
from shipfold.operators import tables as TB
from shipfold.streaming.fold_stream import read_current, start_stream_fold
from tests.test_fold import COLS, SCHEMA, random_log

T0 = dt.datetime(2030, 1, 1)


@pytest.mark.parametrize("n_batches,shuffle", [(1, False), (3, False), (5, True)])
def test_stream_fold_any_split(spark, n_batches, shuffle):
    rng = random.Random(n_batches)
    log = []
    for k in range(60):
        log += random_log(rng, f"k{k % 20}", k * 20, milestone=False)
    want = {r["key"]: r.asDict() for r in FO.fold(spark.createDataFrame(log, SCHEMA), COLS).collect()}
    root = tempfile.mkdtemp()
    order = list(range(len(log)))
    if shuffle:
        rng.shuffle(order)
    for b in range(n_batches):
        part = [log[i] for i in order[b::n_batches]]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(os.path.join(root, "in", f"b{b}"))
    stream = (spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", True).parquet(os.path.join(root, "in")))
    q = start_stream_fold(stream, COLS, os.path.join(root, "out"), os.path.join(root, "ckpt"))
    q.awaitTermination()
    got = {r["key"]: r.asDict() for r in read_current(spark, os.path.join(root, "out"), COLS).collect()}
    assert got == want


def test_snapshot_store_versions(spark):
    root = tempfile.mkdtemp()
    a = spark.createDataFrame([("k", 1, "upsert", {"a": "1"}, T0)], SCHEMA)
    b = spark.createDataFrame([("k", 2, "patch", {"a": "2"}, T0)], SCHEMA)
    TB.append_changes(a, f"{root}/log", 1)
    TB.publish_snapshot(spark, FO.fold(TB.read_changes(spark, f"{root}/log").drop("batch"), COLS), f"{root}/s", 1)
    TB.append_changes(a, f"{root}/log", 1)  # a retried batch replaces itself
    TB.append_changes(b, f"{root}/log", 2)
    TB.publish_snapshot(spark, FO.fold(TB.read_changes(spark, f"{root}/log").drop("batch"), COLS), f"{root}/s", 2)
    assert TB.read_changes(spark, f"{root}/log").count() == 2
    assert TB.read_snapshot(spark, f"{root}/s").first()["a"] == "2"


def test_required_column_and_seed_if_empty(spark):
    df = spark.createDataFrame([("x",)], "shipper string")
    with pytest.raises(ValueError):
        N.require_column(df, "bl_no")
    empty = df.filter(F.lit(False))
    assert TB.seed_if_empty(empty, df).count() == 1
    assert TB.seed_if_empty(df, df).count() == 0
    assert TB.seed_if_empty(df, df, force=True).count() == 1


def test_stream_compaction_keeps_result(spark):
    """Stream, compact, resume the same stream with more changes: the current
    table still equals the one-shot fold of everything."""
    from shipfold.streaming.fold_stream import compact
    rng = random.Random(11)
    log = []
    for k in range(40):
        log += random_log(rng, f"k{k % 10}", k * 20, milestone=False)
    want = {r["key"]: r.asDict() for r in FO.fold(spark.createDataFrame(log, SCHEMA), COLS).collect()}
    root = tempfile.mkdtemp()
    inp, out, ck = os.path.join(root, "in"), os.path.join(root, "out"), os.path.join(root, "ck")

    def run():
        stream = (spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1)
                  .option("recursiveFileLookup", True).parquet(inp))
        start_stream_fold(stream, COLS, out, ck).awaitTermination()

    for b in range(3):
        spark.createDataFrame(log[b::6], SCHEMA).coalesce(1).write.parquet(os.path.join(inp, f"b{b}"))
    run()
    assert compact(spark, out, COLS) is not None
    for b in range(3, 6):
        spark.createDataFrame(log[b::6], SCHEMA).coalesce(1).write.parquet(os.path.join(inp, f"b{b}"))
    run()
    got = {r["key"]: r.asDict() for r in read_current(spark, out, COLS).collect()}
    assert got == want


def test_sorted_snapshot_lookup_is_pushed(spark):
    root = tempfile.mkdtemp()
    cur = spark.range(0, 5000).select(F.format_string("k%05d", "id").alias("key"),
                                      F.col("id").cast("string").alias("a"))
    TB.publish_snapshot(spark, cur, root, 1, cluster_key="key", files=8)
    snap = TB.read_snapshot(spark, root)
    hit = snap.filter(F.col("key") == "k01234")
    plan = hit._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(key,k01234)" in plan
    assert [r["a"] for r in hit.collect()] == ["1234"]
    # files cover disjoint, ordered key ranges
    ranges = (snap.groupBy(F.input_file_name().alias("f"))
              .agg(F.min("key").alias("lo"), F.max("key").alias("hi")).orderBy("lo").collect())
    assert all(a["hi"] < b["lo"] for a, b in zip(ranges, ranges[1:]))
