"""Outcome stream, incremental facets, rank index and clustered lookup."""

import datetime as dt
import os
import random
import tempfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from shipfold.operators import aggregates as A
from shipfold.operators import facet_state as FS
from shipfold.operators import fold as FO
from shipfold.operators import page_index as PI
from shipfold.operators import tables as TB
from shipfold.streaming.outcome_stream import BUCKETS, OUTCOMES, FirstInserts, outcomes, start_outcome_stream
from tests.test_fold import COLS, SCHEMA, random_log

T0 = dt.datetime(2030, 1, 1)


def _log(seed, n=50, keys=12):
    rng, log = random.Random(seed), []
    for k in range(n):
        log += random_log(rng, f"k{k % keys}", k * 20, milestone=False)
    log += [(f"p{k}", 5000 + k, "patch", {"a": "1"} if k % 3 else {}, T0) for k in range(30)]  # never inserted
    return sorted(log, key=lambda r: r[1])


@pytest.mark.parametrize("cuts", [(), (1,), (40, 41, 90)])
def test_outcome_stream_of_any_ordered_split(spark, cuts):
    log = _log(len(cuts))
    want = sorted(map(tuple, FO.dispositions(spark.createDataFrame(log, SCHEMA)).collect()))
    assert {w[3] for w in want} == {"upserted", "ok", "not_found", "skipped"}
    root = tempfile.mkdtemp()
    edges = [0, *cuts, len(log)]
    for b, (x, y) in enumerate(zip(edges, edges[1:])):
        part = log[x:y]
        random.Random(b).shuffle(part)  # inside a batch any order will do
        spark.createDataFrame(part, SCHEMA).repartition(3).write.parquet(os.path.join(root, "in", f"b{b}"))
        # Each batch is a run of its own: a restart goes on from the checkpoint.
        stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).parquet(os.path.join(root, "in"))
        start_outcome_stream(stream, os.path.join(root, "out"), os.path.join(root, "ckpt")).awaitTermination()
    got = spark.read.schema(OUTCOMES).parquet(os.path.join(root, "out")).collect()
    assert sorted(map(tuple, got)) == want


def test_outcome_stream_holds_a_key_in_chunks(spark):
    """A key's rows come in several chunks, its insert last."""
    rows = [("k", i, "patch", {"a": str(i)}, T0) for i in range(300)] + [("k", 150, "upsert", {"a": "x"}, T0)]
    rows = [r for r in rows if r[1] != 150 or r[2] == "upsert"]
    root = tempfile.mkdtemp()
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{root}/in")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        start_outcome_stream(spark.readStream.schema(SCHEMA).parquet(f"{root}/in"), f"{root}/out", f"{root}/ck").awaitTermination()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    got = {r.seq: r.disposition for r in spark.read.parquet(f"{root}/out").collect()}
    assert got == {i: "upserted" if i == 150 else "ok" if i > 150 else "not_found" for i in range(300)}


class _States(dict):
    """Map state in memory, with the keys read and written."""

    def __init__(self):
        self.read, self.written = [], []

    def getMapState(self, name, keys, values):
        return self

    def getValue(self, key):
        self.read.append(key)
        return self.get(key)

    def updateValue(self, key, value):
        self.written.append(key)
        self[key] = value


def test_outcomes_of_a_bucket_of_keys_take_one_call():
    """Many keys in one call, in chunks that cut across them; state is read once a key, written where it is new."""
    def pdf(rows):
        return pd.DataFrame(rows, columns=["key", "seq", "kind", "empty"])

    states, judge = _States(), FirstInserts()
    judge.init(states)
    chunks = [pdf([(f"k{k}", k * 10 + c, "upsert" if c == 2 and k % 2 else "patch", False) for k in range(50)]) for c in range(4)]
    out = pd.concat(judge.handleInputRows((7,), iter(chunks), None))
    want = {k * 10 + c: "not_found" if not k % 2 or c < 2 else "upserted" if c == 2 else "ok" for k in range(50) for c in range(4)}
    assert dict(zip(out["seq"], out["disposition"])) == want and len(out) == 200
    assert len(states.read) == 50 and sorted(states.written) == sorted((f"k{k}",) for k in range(1, 50, 2))
    later = [pdf([("k1", 900, "patch", False), ("k2", 901, "patch", False), ("k1", 902, "upsert", False), ("k3", 903, "patch", True)])]
    out = pd.concat(judge.handleInputRows((7,), iter(later), None))
    assert dict(zip(out["seq"], out["disposition"])) == {900: "ok", 901: "not_found", 902: "upserted", 903: "skipped"}
    assert len(states.written) == 25


def test_outcome_stream_groups_keys_and_takes_a_null_key(spark):
    rows = [(None, 1, "patch", {"a": "1"}, T0), (None, 2, "upsert", {"a": "1"}, T0), (None, 3, "patch", {"a": "1"}, T0)]
    rows += [(f"k{k}", 10 + k, "patch", {"a": "1"}, T0) for k in range(2 * BUCKETS)]
    root = tempfile.mkdtemp()
    for b, part in enumerate((rows, [(None, 5000, "patch", {"a": "2"}, T0)])):
        spark.createDataFrame(part, SCHEMA).write.parquet(f"{root}/in/b{b}")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{root}/in/b*")
        assert outcomes(stream).isStreaming
        start_outcome_stream(stream, f"{root}/out", f"{root}/ck").awaitTermination()
    got = {r.seq: r.disposition for r in spark.read.schema(OUTCOMES).parquet(f"{root}/out").collect()}
    assert got == {1: "not_found", 2: "upserted", 3: "ok", 5000: "ok", **{10 + k: "not_found" for k in range(2 * BUCKETS)}}


LABELLED, TOP = {"by_a": ("a", "Unknown")}, {"by_b": "b"}


def test_facets_of_batches_equal_the_report_of_the_fold(spark):
    log, root = _log(9, 80, 25), tempfile.mkdtemp()
    edges = [0, 30, 31, 120, len(log)]
    for k, (x, y) in enumerate(zip(edges, edges[1:]), 1):
        FS.publish_batch(spark.createDataFrame(log[x:y], SCHEMA), root, k, COLS, LABELLED, TOP)
        rows = FO.fold(spark.createDataFrame(log[:y], SCHEMA), COLS)
        want = sorted(map(tuple, A.facet_report(rows, LABELLED, TOP, k=3).collect()), key=str)
        assert sorted(map(tuple, FS.read_report(spark, root, TOP, 3).collect()), key=str) == want
    with pytest.raises(ValueError):
        FS.publish_batch(spark.createDataFrame(log[:1], SCHEMA), root, 4, COLS, LABELLED, TOP)


def test_a_batch_reads_only_the_buckets_it_touches(spark):
    root = tempfile.mkdtemp()
    first = [(f"k{i}", i, "upsert", {"a": str(i % 3)}, T0) for i in range(500)]
    FS.publish_batch(spark.createDataFrame(first, SCHEMA), root, 1, COLS, LABELLED, TOP)
    one = spark.createDataFrame([("k7", 900, "patch", {"a": "z"}, T0)], SCHEMA)
    bucket = [r[0] for r in one.select(FS._bucket()).collect()]
    old = FS.old_states(spark, root, 1, bucket, one.select("key"))
    plan = old._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1][:200]
    assert [r.key for r in old.collect()] == ["k7"]
    FS.publish_batch(one, root, 2, COLS, LABELLED, TOP)
    assert {r.key for r in spark.read.parquet(f"{root}/state/version=2").collect()} == {"k7"}
    counts = {(r.facet, r.label): r.cnt for r in FS.read_report(spark, root, TOP, 5).collect()}
    assert counts == {("total", None): 500, ("by_a", "0"): 167, ("by_a", "1"): 166, ("by_a", "2"): 166, ("by_a", "z"): 1}
    # A batch that failed before its commit is run again.
    spark.createDataFrame([("k8", 1)], "key string, n int").write.parquet(f"{root}/state/version=3/bucket=1")
    FS.publish_batch(spark.createDataFrame([("k8", 901, "patch", {"a": "z"}, T0)], SCHEMA), root, 3, COLS, LABELLED, TOP)
    assert FS.read_report(spark, root, TOP, 5).filter("label = 'z'").first().cnt == 2


def test_pages_by_rank_index(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, "a", "b", "c"])) for i in range(2000)]
    df = spark.createDataFrame(rows, "n long, g string").repartition(5)
    root = tempfile.mkdtemp()
    PI.write_page_index(df, ["g", "n"], root, 16)
    want = sorted(rows, key=lambda r: (r[1] is not None, r[1] or "", r[0]), reverse=True)
    for page, size in ((1, 50), (2, 7), (21, 50), (40, 50), (41, 50), (4, 500), (5, 500), (99, 500)):
        got = PI.seek_page(spark, root, ["g", "n"], page, size)
        assert [tuple(r) for r in got.collect()] == want[(page - 1) * size:page * size]
    assert len(PI.slices_of(spark, root, 1000, 50)) <= 2
    page = PI.seek_page(spark, root, ["g", "n"], 21, 50)
    assert "PartitionFilters: [isnotnull(slice" in page._jdf.queryExecution().executedPlan().toString()
    none = root + "/none"
    PI.write_page_index(df.limit(0), ["g", "n"], none, 4)
    assert PI.seek_page(spark, none, ["g", "n"]).collect() == []


def test_lookup_skips_other_row_groups(spark):
    """The key is in the range of one file, and its Bloom filter skips that too if it is not there."""
    import pyarrow.parquet as pq
    root = tempfile.mkdtemp()
    cur = spark.range(0, 6000).select(F.format_string("k%06d", F.col("id") * 2).alias("mawb"), F.col("id").cast("string").alias("a"))
    TB.publish_snapshot(spark, cur, root, 1, cluster_key="mawb", files=6)
    snap = TB.read_snapshot(spark, root)

    def read(key):
        hit = snap.filter(F.col("mawb") == key)
        plan = hit._jdf.queryExecution().executedPlan()
        assert f"EqualTo(mawb,{key})" in plan.toString() and "cast(mawb" not in plan.toString()
        rows = hit.collect()
        done = hit._jdf.queryExecution().executedPlan()
        while "Scan" not in done.nodeName():
            done = done.executedPlan() if done.nodeName() == "AdaptiveSparkPlan" else done.children().head()
        return len(rows), done.metrics().apply("numOutputRows").value()

    n, scanned = read("k004000")
    assert n == 1 and 0 < scanned <= 6000 // 6 + 500
    n, scanned = read("k004001")  # inside a file's range, but absent
    assert n == 0 and scanned == 0
    parts = [os.path.join(d, f) for d, _, fs in os.walk(root) for f in fs if f.endswith(".parquet") and "/data/" in d]
    assert len(parts) == 6 and all(pq.ParquetFile(p).metadata.num_rows for p in parts)
