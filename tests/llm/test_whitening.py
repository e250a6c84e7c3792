"""Whitening against numpy over all rows."""

import math
from collections import defaultdict

import numpy as np

from shipfold.llm import whitening as W

NAMES = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def _check(df, rows, components=32, **kw):
    """Every column of every row against numpy and exact integers; rows are (id, vector)."""
    got = W.whiten(df, components=components, **kw)
    assert got.columns == NAMES
    assert [t for _, t in got.dtypes[1:]] == ["int", "bigint", "bigint", "double", "double", "double"]
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for _, v in rows]
    n, d = len(x), len(x[0])
    sums = [sum(v[i] for v in x) for i in range(d)]
    centred = np.array([[(n * v[i] - sums[i]) / n for i in range(d)] for v in x])
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1], u[:, ::-1]
    k = min(components, d)
    want = centred @ u[:, :k]
    by_row = defaultdict(dict)
    got = got.collect()
    assert len(got) == n * k
    for r in got:
        by_row[r.vec_id, r.deviation].setdefault(r.component, []).append(r)
        assert r.n == n and abs(r.explained - e[r.component - 1] / e.sum()) <= 1e-9 and r.identity_error <= 1e-8
    signs = np.zeros(k)
    for (i, v), row, raw in zip(rows, want, x, strict=True):
        deviation = sum((n * c - s) ** 2 for c, s in zip(raw, sums, strict=True))
        for j in range(k):
            value = row[j] / math.sqrt(e[j])
            if not signs[j] and abs(value) > 0.1:
                signs[j] = np.sign(value * by_row[i, deviation][j + 1][0].whitened)
            near = [r for r in by_row[i, deviation][j + 1] if abs(r.whitened - (signs[j] or 1) * value) < 1e-6]
            assert near or not signs[j], (i, j)
    return got


def test_whitening_matches_numpy(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    _check(df.repartition(5), rows)
    _check(df, rows, rows_per_block=32, cols_per_block=24)  # many blocks, in both directions


def test_hostile_rows_take_no_part(spark):
    rng = np.random.default_rng(1)
    fine = [(i // 2 if i != 9 else None, rng.standard_normal(6).tolist()) for i in range(60)]
    fine += [fine[3], fine[3], (777, [1e3, -1e3, 0.0, 3.25, 1e-9, -5.0])]
    odd = [(1, None), (2, []), (3, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (4, [float("nan")] * 6), (5, [float("inf")] + [0.0] * 5),
           (6, [1.0, 2.0]), (7, [1e300] * 6), (8, [2.0 ** 40] * 6)]
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in fine + odd], "vec_id long, embedding array<double>, index int, x string")
    got = _check(df.repartition(4), [(i, v) for i, v in fine])
    assert {r.vec_id for r in got} == {i for i, _ in fine}
    none = W.whiten(df.limit(0))
    assert none.columns == NAMES and none.count() == 0


def test_flat_directions_and_single_rows(spark):
    schema = "vec_id long, embedding array<float>"
    one = W.whiten(spark.createDataFrame([(5, [1.5, 2.0])], schema)).collect()
    assert [(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained) for r in one] == [
        (5, 1, 1, 0, None, None), (5, 2, 1, 0, None, None)]
    flat = [(i, [i * 0.25, 1.0, -i * 0.25]) for i in range(40)]  # rank one
    got = W.whiten(spark.createDataFrame(flat, schema)).collect()
    first = sorted(r.whitened for r in got if r.component == 1)
    assert len(got) == 120 and all(r.whitened is None for r in got if r.component > 1)
    assert abs(np.mean(np.square(first)) - 1) < 1e-9 and all(r.identity_error < 1e-9 for r in got)
    assert all(abs(r.explained - (r.component == 1)) < 1e-9 for r in got)
    same = W.whiten(spark.createDataFrame([(i, [3.0, 4.0]) for i in range(9)], schema)).collect()
    assert len(same) == 18 and all(r.whitened is None and r.deviation == 0 and r.identity_error == 0 for r in same)


def test_deviation_is_exact_or_null(spark):
    """Past 64 bits it is null, never rounded."""
    big = float((1 << 40) - 1)
    df = spark.createDataFrame([(1, [big, 0.0]), (2, [-big, 0.0]), (3, [0.0, 0.5])], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.deviation for r in W.whiten(df).collect()}
    assert got[1] is None and got[2] is None
    x = [(64 * int(big) + 10 ** 6, 10 ** 6), (-64 * int(big) + 10 ** 6, 10 ** 6), (10 ** 6, 10 ** 6 + 32)]
    sums = [sum(c) for c in zip(*x, strict=True)]
    assert got[3] == sum((3 * c - s) ** 2 for c, s in zip(x[2], sums, strict=True))
