"""End to end through the store, on invented rows: the data checks the
original service's smoke script makes, plus upload, bulk and stats flows."""

import datetime as dt
import json
import os
import tempfile

from pyspark.sql import functions as F

from shipfold.profiles import ATD_ATA, IMPORT_CONFIRM
from shipfold.store import ShipmentStore

T1 = dt.datetime(2030, 1, 1, 8, 0)
T2 = dt.datetime(2030, 1, 1, 9, 0)
T3 = dt.datetime(2030, 1, 1, 10, 0)


def _seed_milestones(spark, store):
    rows = [{"mno": f"777-{i:08d}", "customer": f"CUST{i % 3}", "pod": "XYZ" if i % 2 else "ABC",
             "etd": "2030-01-01 06:00:00", "eta": "2030-01-02 06:00:00",
             "atd": "2030-01-01 07:00:00" if i < 4 else "", "ata": "", "status":
             "Pending Arrival" if i < 4 else "Pending Depart"} for i in range(10)]
    df = spark.createDataFrame([(r,) for r in rows], "p map<string,string>")
    mapping = {"mno": "mawb", "customer": "customer", "pod": "pod", "etd": "etd_orig",
               "eta": "eta", "atd": "atd", "ata": "ata", "status": "status"}
    store.seed(df, "p", mapping, T1)


def test_milestone_flows(spark):
    store = ShipmentStore(spark, tempfile.mkdtemp(), ATD_ATA)
    _seed_milestones(spark, store)
    cur = store.current()
    assert cur.count() == 10
    # a key-substring filter finds exactly one row
    assert store.list_all({"customer": "All"}, key_like="0000005").count() == 1
    # single ATA write: value stored, status Completed
    p = spark.createDataFrame([("777-00000001", {"ata": "2030-01-02 05:00:00"})], "k string, m map<string,string>")
    out = store.patch(p, "k", "m", T2).collect()
    assert [r["disposition"] for r in out] == ["ok"]
    row = store.get("777-00000001").first()
    assert (row["ata"], row["status"]) == ("2030-01-02 05:00:00", "Completed")
    # a patch with its own status keeps it; unknown key is not_found; empty is skipped
    p2 = spark.createDataFrame([("777-00000002", {"flight": "XY123", "status": "Pending Depart"}),
                                ("999-00000000", {"atd": "x"}), ("777-00000003", {}),
                                ("777-00000004", {"pod": "QQQ"})],
                               "k string, m map<string,string>")
    outcomes = {r["mawb"]: r["disposition"] for r in store.patch(p2, "k", "m", T2).collect()}
    assert outcomes == {"777-00000002": "ok", "999-00000000": "not_found", "777-00000003": "skipped",
                        "777-00000004": "skipped"}  # pod is not a write-back field
    assert store.get("777-00000004").first()["pod"] == "ABC"
    assert store.get("777-00000002").first()["status"] == "Pending Depart"
    # batch of three ATD writes (one key padded, one blank dropped), one refused batch
    payloads = spark.createDataFrame([
        (json.dumps({"mawbs": ["777-00000006", " 777-00000007 ", "", "777-00000008"],
                     "field": "ATD", "value": "2030-01-01 09:30:00"}),),
        (json.dumps({"mawbs": ["777-00000009"], "field": "eta", "value": "x"}),)], "t string")
    outcomes, refused = store.flat_batch(payloads, "t", T3)
    assert sorted(r["disposition"] for r in outcomes.collect()) == ["ok", "ok", "ok"]
    assert refused.count() == 1
    cur = {r["mawb"]: r for r in store.current().collect()}
    for k in ("777-00000006", "777-00000007", "777-00000008"):
        assert cur[k]["atd"] == "2030-01-01 09:30:00" and cur[k]["status"] == "Pending Arrival"
        assert cur[k]["last_updated"] == T3
    assert cur["777-00000009"]["atd"] == ""


def test_import_confirm_upload_bulk_stats(spark):
    root = tempfile.mkdtemp()
    store = ShipmentStore(spark, os.path.join(root, "ic"), IMPORT_CONFIRM)
    csv = os.path.join(root, "up.csv")
    with open(csv, "w") as fh:
        fh.write("M#,Status,Airline,Firm Code,ETA\n"
                 "900-1,New,EXAMPLE AIR(X1),F1,2030-01-05 08:00:00\n"
                 "900-2,,SAMPLE CARGO(X2),F1,\n"
                 "None,New,EXAMPLE AIR(X1),F2,\n")
    tally = store.upload_csv([csv], T1)[0].first()
    assert (tally["upserted"], tally["skipped"]) == (2, 1)
    # bulk: blank overwrites with NULL; an unknown column fails alone
    payload = spark.createDataFrame([(json.dumps([
        {"mawb": "900-2", "airline": " ", "bot_status": "arrived"},
        {"mawb": "900-3", "status": "Partial"},
        {"mawb": "900-4", "no_such_column": "x"},
        {"mawb": "nan"}]),)], "t string")
    tally, errors = store.bulk(payload, "t", T2)
    assert (tally.first()["upserted"], tally.first()["skipped"]) == (2, 2)
    assert [r["mawb"] for r in errors.collect()] == ["900-4"]
    cur = {r["mawb"]: r for r in store.current().collect()}
    assert cur["900-2"]["airline"] is None and cur["900-2"]["bot_status"] == "arrived"
    assert cur["900-1"]["bot_status"] == "pending"
    # re-upload of an arrived row puts it back to pending
    store.upload_csv([csv], T3)
    assert store.get("900-2").first()["bot_status"] == "pending"
    env, items = store.list({"status": "New"}, page=1, page_size=50)
    assert env.first()["total"] == 1 and items.first()["mawb"] == "900-1"
    stats = {(r["facet"], r["label"]): r["cnt"] for r in store.stats().collect()}
    assert stats[("total", None)] == 3
    assert stats[("by_status", "Unknown")] == 1 and stats[("by_bot_status", "pending")] == 3
    assert store.publish() >= 1 and store.snapshot().count() == 3


def test_batch_outcomes_equal_the_whole_log_dispositions(spark):
    # A batch's outcomes come from its own rows and the first inserts of the
    # keys it touches; they must equal the dispositions of the whole log.
    from shipfold.operators import fold as FO
    from shipfold.store import BATCH_SHIFT
    store = ShipmentStore(spark, tempfile.mkdtemp(), IMPORT_CONFIRM)
    early = spark.createDataFrame([(f"k{i}", {"eta": "x"}) for i in range(5)], "k string, m map<string,string>")
    store.patch(early, "k", "m", T1)  # before any insert: not_found
    payload = spark.createDataFrame([(json.dumps([{"mawb": f"k{i}", "eta": "y"} for i in range(3)]),)], "t string")
    store.bulk(payload, "t", T2)
    late = spark.createDataFrame([(f"k{i}", {"eta": "z"} if i < 4 else {}) for i in range(6)],
                                 "k string, m map<string,string>")
    got = sorted((r["mawb"], r["seq"], r["disposition"]) for r in store.patch(late, "k", "m", T3).collect())
    batch = max(r["seq"] for r in store.changes().collect()) >> BATCH_SHIFT
    whole = FO.dispositions(store.changes().drop("batch")).filter(F.col("seq") >= F.lit(batch << BATCH_SHIFT))
    want = sorted((r["key"], r["seq"], r["disposition"]) for r in whole.collect())
    assert got == want
    assert [d for _, _, d in got] == ["ok", "ok", "ok", "not_found", "skipped", "skipped"]


def test_a_batch_is_never_written_over(spark, tmp_path):
    import pytest
    from pyspark.errors import AnalysisException
    from shipfold.operators import tables as TB
    ch = spark.createDataFrame([("1", 1)], "key string, seq long")
    TB.append_changes(ch, str(tmp_path), 1)
    with pytest.raises(AnalysisException):
        TB.append_changes(ch, str(tmp_path), 1, replace=False)


def test_reset_of_stored_tables(spark, tmp_path):
    """Tables under the root that is reset, one seeded from itself, one without a seed."""
    from shipfold.operators import tables as TB
    for name in ("a", "b"):
        spark.range(10).write.parquet(f"{tmp_path}/{name}")
    current = {name: spark.read.parquet(f"{tmp_path}/{name}") for name in ("a", "b")}
    got = TB.reset_tables(spark, str(tmp_path), current, {"a": current["a"].where("id < 3")})
    assert sorted(map(tuple, got.collect())) == [("a", 10, 3), ("b", 10, 0)]


def test_snapshot_state_and_log_tail(spark, tmp_path):
    """Reads after a snapshot read it and the later batches only, and agree with the fold of the whole log."""
    from shipfold.operators import fold as FO
    store = ShipmentStore(spark, str(tmp_path), IMPORT_CONFIRM)
    patch = "k string, m map<string,string>"
    store.patch(spark.createDataFrame([("k1", {"eta": "early"})], patch), "k", "m", T1)
    store.bulk(spark.createDataFrame([(json.dumps([{"mawb": f"k{i}", "eta": "y"} for i in range(3)]),)], "t string"), "t", T1)
    assert store.publish() == 2 and store.publish() == 2 and store.snapshot().count() == 3
    out = store.patch(spark.createDataFrame([("k1", {"eta": "z", "status": "New"}), ("k9", {"eta": "z"}), ("k2", {})], patch), "k", "m", T2)
    assert sorted((r["mawb"], r["disposition"], r["changed"]) for r in out.collect()) == [
        ("k1", "ok", ["eta", "status"]), ("k2", "skipped", None), ("k9", "not_found", None)]
    cur = store.current()
    files = [f for f in cur.inputFiles() if "/log/" in f]
    whole = FO.fold(store.changes().drop("batch"), IMPORT_CONFIRM.value_columns, key_name="mawb")
    assert sorted(map(tuple, cur.collect())) == sorted(map(tuple, whole.collect()))
    plan = store.get("k1")._jdf.queryExecution().executedPlan().toString()
    assert "batch#" in plan and "(batch" in plan[plan.index("PartitionFilters"):] and plan.count("EqualTo(key,k1)") >= 2, files
    assert store.get("k1").first()["eta"] == "z"
    assert store.publish() == 3
    assert sorted(map(tuple, store.snapshot().collect())) == sorted(map(tuple, whole.collect()))


def test_reset_and_nested_write_back(spark, tmp_path):
    store = ShipmentStore(spark, str(tmp_path), ATD_ATA)
    _seed_milestones(spark, store)
    store.publish()
    bodies = spark.createDataFrame([
        (2, json.dumps({"items": [{"mawb": "777-00000001", "result": {"ata": "second"}}]})),
        (1, json.dumps({"items": [{"mawb": "777-00000001", "result": {"ata": "first", "pod": "no"}},
                                  {"mawb": "nope", "result": {"ata": "x"}}]})), (3, "{")], "n int, t string")
    out, refused = store.batch_update(bodies, "t", T2, order_col="n")
    assert sorted((r["mawb"], r["disposition"]) for r in out.collect()) == [
        ("777-00000001", "ok"), ("777-00000001", "ok"), ("nope", "not_found")]
    assert refused.count() == 1 and store.get("777-00000001").first()["ata"] == "second"
    seed = spark.createDataFrame([({"mno": "1", "atd": "x"},), ({"mno": ""},)], "p map<string,string>")
    assert tuple(store.reset(T3, seed, "p", {"mno": "mawb", "atd": "atd"}).first()) == ("atd_ata", 10, 1)
    assert [r["mawb"] for r in store.current().collect()] == ["1"]
    store.patch(spark.createDataFrame([("1", {"ata": "y"})], "k string, m map<string,string>"), "k", "m", T3)
    assert store.get("1").first()["status"] == "Completed" and store.publish() == 2
    assert tuple(store.reset(T3).first()) == ("atd_ata", 1, 0) and store.current().count() == 0


def test_refused_upload_files_and_workbooks(spark, tmp_path):
    from tests.test_sources import _xlsx
    (tmp_path / "ok.csv").write_text('M#,Address\n1,"12 Road\nTown"\n,x\n')
    (tmp_path / "wide.csv").write_text("M#,ETA\n2,c,EXTRA\n")
    (tmp_path / "w.xlsx").write_bytes(_xlsx([["M#", "ETA"], ["3", "e"]]))
    store = ShipmentStore(spark, str(tmp_path / "s"), IMPORT_CONFIRM)
    tally, refused = store.upload_csv([str(tmp_path / "ok.csv"), str(tmp_path / "wide.csv")], T1)
    assert tuple(tally.first()) == (1, 1)
    assert [os.path.basename(r["file_path"]) for r in refused.collect()] == ["wide.csv"]
    tally, refused = store.upload_workbook([str(tmp_path / "w.xlsx")], T2)
    assert tuple(tally.first()) == (1, 0) and refused.count() == 0
    assert {r["mawb"]: r["address"] for r in store.current().collect()} == {"1": "12 Road\nTown", "3": None}
