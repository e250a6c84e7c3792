"""The fold against a plain sequential interpreter of the change rules."""

import datetime as dt
import random

from pyspark.sql import functions as F
from pyspark.sql import types as T

from shipfold.operators import changes as C
from shipfold.operators import fold as FO

COLS = ("a", "b", "status", "atd", "ata")
SCHEMA = T.StructType([
    T.StructField("key", T.StringType()),
    T.StructField("seq", T.LongType()),
    T.StructField("kind", T.StringType()),
    T.StructField("fields", T.MapType(T.StringType(), T.StringType())),
    T.StructField("ts", T.TimestampNTZType()),
])
T0 = dt.datetime(2030, 1, 1)


def derive(row):
    if row.get("ata"):
        return "Completed"
    if row.get("atd"):
        return "Pending Arrival"
    return "Pending Depart"


def interpret(log, milestone):
    """Request-at-a-time application, as the original service does it."""
    table, disp = {}, {}
    for key, seq, kind, fields, ts in sorted(log, key=lambda r: r[1]):
        if kind == "replace":
            row = {c: None for c in COLS}
            row.update(fields)
            table[key] = {"row": row, "row_seq": seq, "ts": ts}
            disp[seq] = "upserted"
        elif kind == "upsert":
            if key in table:
                table[key]["row"].update(fields)
                table[key]["ts"] = ts
            else:
                row = {c: None for c in COLS}
                row.update(fields)
                table[key] = {"row": row, "row_seq": seq, "ts": ts}
            disp[seq] = "upserted"
        else:
            if not fields:
                disp[seq] = "skipped"
            elif key not in table:
                disp[seq] = "not_found"
            else:
                upd = dict(fields)
                if milestone:
                    merged = dict(table[key]["row"])
                    merged.update(upd)
                    upd.setdefault("status", derive(merged))
                table[key]["row"].update(upd)
                table[key]["ts"] = ts
                disp[seq] = "ok"
    return table, disp


def random_log(rng, key, seq0, milestone):
    log = []
    values = [None, "", "x", "y", "2030-01-02 10:00:00"]
    kinds = ["replace", "upsert", "patch"] if not milestone else ["replace", "patch"]
    for i in range(rng.randint(1, 9)):
        kind = rng.choice(kinds + ["patch"])
        cols = rng.sample(COLS, rng.randint(0, 3))
        fields = {c: rng.choice(values) for c in cols}
        if kind == "patch":
            fields = {c: v for c, v in fields.items() if v is not None}
        log.append((key, seq0 + i, kind, fields, T0 + dt.timedelta(minutes=seq0 + i)))
    return log


def _check(spark, milestone, n_logs=400, seed=7):
    rng = random.Random(seed + milestone)
    logs = []
    for k in range(n_logs):
        logs += random_log(rng, f"k{k % (n_logs // 2)}", k * 20, milestone)
    df = spark.createDataFrame(logs, SCHEMA)
    got = {r["key"]: r for r in FO.fold(df, COLS, milestone=milestone).collect()}
    want, disp = interpret(logs, milestone)
    assert set(got) == set(want)
    for key, w in want.items():
        g = got[key]
        for c in COLS:
            assert g[c] == w["row"][c], (key, c, g, w)
        assert g["row_seq"] == w["row_seq"]
        assert g["last_updated"] == w["ts"]
    got_disp = {r["seq"]: r["disposition"] for r in FO.dispositions(df).collect()}
    assert got_disp == disp


def test_fold_matches_interpreter(spark):
    _check(spark, milestone=False)


def test_milestone_fold_matches_interpreter(spark):
    _check(spark, milestone=True)


def test_fold_is_one_shuffle(spark):
    df = spark.createDataFrame([("k", 1, "upsert", {"a": "1"}, T0)], SCHEMA)
    plan = FO.fold(df, COLS)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_upsert_default_and_bulk_null(spark):
    from shipfold.profiles import IMPORT_CONFIRM
    rows = spark.createDataFrame(
        [({"mawb": " 900-1 ", "status": "New"},), ({"mawb": "nan"},), ({"status": "x"},)],
        "fields map<string,string>")
    ch, rej = C.upload_changes(rows, IMPORT_CONFIRM, F.lit(1), F.lit(T0))
    got = ch.collect()
    assert len(got) == 1 and rej.count() == 2
    assert got[0]["key"] == "900-1"
    assert got[0]["fields"] == {"mawb": "900-1", "status": "New", "bot_status": "pending"}
    bulk = spark.createDataFrame(
        [({"mawb": "900-2", "bot_status": " ", "eta": " None "},)], "fields map<string,string>")
    bch, _ = C.bulk_changes(bulk, IMPORT_CONFIRM, F.lit(2), F.lit(T0))
    f = bch.collect()[0]["fields"]
    assert f == {"mawb": "900-2", "bot_status": None, "eta": None}


def test_reupload_resets_bot_status(spark):
    from shipfold.profiles import IMPORT_CONFIRM
    log = spark.createDataFrame([
        ("900-1", 1, "upsert", {"mawb": "900-1", "bot_status": "pending"}, T0),
        ("900-1", 2, "patch", {"bot_status": "arrived", "ata": "2030-01-01 10:00:00"}, T0),
        ("900-1", 3, "upsert", {"mawb": "900-1", "bot_status": "pending", "eta": "e"}, T0),
    ], SCHEMA)
    r = FO.fold(log, IMPORT_CONFIRM.value_columns).collect()[0]
    assert r["bot_status"] == "pending" and r["ata"] == "2030-01-01 10:00:00" and r["eta"] == "e"


def test_replace_drops_old_columns_and_moves_row(spark):
    log = spark.createDataFrame([
        ("k", 1, "upsert", {"a": "1", "b": "2"}, T0),
        ("k", 2, "replace", {"a": "3"}, T0),
        ("k", 3, "upsert", {"b": "4"}, T0),
    ], SCHEMA)
    r = FO.fold(log, COLS).collect()[0]
    assert (r["a"], r["b"], r["row_seq"]) == ("3", "4", 2)
