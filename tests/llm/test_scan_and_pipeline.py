"""The adaptive scan against brute force, and the pipeline stage by stage."""

import re
from collections import defaultdict

import numpy as np

import corpus_pipeline
from pyspark.sql import functions as F
from shipfold.llm import adaptive_scan as A
from shipfold.llm.best_fit import best_fit
from shipfold.llm.source_mix import source_mix

IS_QUERY = "pmod(id, 20) = 0"


def _brute(rows, k=20):
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], float)
    out = {}
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        order = [i for i in np.lexsort((ids, -np.round(s, 12))) if ids[i] != ids[q]][:k]
        out[int(ids[q])] = [(int(ids[i]), s[i]) for i in order]
    return out


def _check(df, rows, least):
    got = defaultdict(list)
    for r in df.orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    want = _brute(rows)
    vec = {r[0]: np.array(r[1], float) for r in rows}
    hits = 0
    assert set(got) == {q for q, w in want.items() if w}
    for q, w in want.items():
        assert [g[0] for g in got[q]] == list(range(1, len(w) + 1))
        assert all(abs(g[2] - vec[q] @ vec[g[1]]) < 1e-9 for g in got[q])
        assert [(-g[2], g[1]) for g in got[q]] == sorted((-g[2], g[1]) for g in got[q])
        hits += len({g[1] for g in got[q]} & {i for i, _ in w})
    assert hits >= least * sum(map(len, want.values()))


def test_scan_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got = A.nearest_neighbours(df, IS_QUERY)
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
    _check(got, rows, 0.95)
    _check(A.nearest_neighbours(df, IS_QUERY, chunk_rows=16), rows, 0.9)  # several chunks and blocks of queries


def test_scan_skips_most_products_and_keeps_recall():
    """Clustered vectors: work is counted, recall is against brute force."""
    rng = np.random.default_rng(3)
    for n, d, noise, most in ((50_000, 64, 0.35, 0.5), (20_000, 512, 0.5, 0.25)):
        centres = rng.standard_normal((300, d))
        x = centres[rng.integers(0, 300, n)] + noise * rng.standard_normal((n, d))
        index = A.Index(x[:4000], float(np.sqrt((x ** 2).sum(axis=1).max())), n, 20, 0.97)
        chunk = A.Chunk(index, np.arange(n), x)
        at, found, _ = chunk.scan(np.arange(200), x[:200], 20)
        score = x[:200] @ x.T
        score[np.arange(200), np.arange(200)] = -np.inf
        want = np.argsort(-score, axis=1)[:, :20]
        assert sum(len(set(found[at == q]) & set(want[q])) for q in range(200)) >= 0.93 * want.size
        assert chunk.products <= most * chunk.all_products


def test_repeated_query_ids_are_ranked_apart(spark):
    rng = np.random.default_rng(6)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((300, 12)), 1)]
    rows += [(20, (-np.array(rows[19][1])).tolist()), (40, rows[39][1]), (40, rows[39][1])]
    got = A.nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), IS_QUERY, recall=1.0).collect()
    x, ids = np.array([r[1] for r in rows]), np.array([r[0] for r in rows])
    want = []
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        order = [i for i in np.lexsort((ids, -np.round(s, 12))) if ids[i] != ids[q]][:20]
        want += [(int(ids[q]), k, int(ids[i]), round(s[i], 9)) for k, i in enumerate(order, 1)]
    have = sorted((r.query_id, r["rank"], round(r.score, 9)) for r in got)
    assert have == sorted((q, k, s) for q, k, _, s in want)
    assert len({(r.query_id, r["rank"], r.vec_id) for r in got if r.query_id == 20}) == 40


def test_scan_of_unequal_norms_and_copies(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((700, 24)) * rng.uniform(0.2, 3, (700, 1))
    x[300:600] = x[5]  # a third and more is one vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    _check(A.nearest_neighbours(df, IS_QUERY, chunk_rows=100), rows, 0.9)


def test_scan_odd_tables(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, [float(i % 7 + 1), float(i % 3), 1.0]) for i in range(45)]
    odd = [(100, None), (120, []), (140, [0.0, 0.0, 0.0]), (160, [1.0, None, 2.0]), (180, [nan, 1.0, 1.0]), (200, [inf, 1.0, 1.0]),
           (220, [1.0, 2.0]), (None, [1.0, 1.0, 1.0])]
    schema = "vec_id long, embedding array<float>, rank int, list int, vec string"
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in good + odd], schema)
    _check(A.nearest_neighbours(df, IS_QUERY), good, 0.95)
    few = spark.createDataFrame([(*r, 1, 2, "x") for r in good[:4]], schema)
    _check(A.nearest_neighbours(few, IS_QUERY), good[:4], 1)
    assert A.nearest_neighbours(spark.createDataFrame([(20, [1.0], 1, 1, "")], schema), IS_QUERY).count() == 0
    assert A.nearest_neighbours(df.where("vec_id = 1"), IS_QUERY).count() == 0
    assert A.nearest_neighbours(df.limit(0), IS_QUERY).count() == 0


def test_no_true_neighbour_is_abandoned_without_the_test(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((500, 20))
    monkeypatch.setattr(A, "EPSILON", 100.0)  # never abandons before the last block
    index = A.Index(x, float(np.linalg.norm(x, axis=1).max()), 500, 20, 0.97)
    ids = np.arange(500)
    at, found, _ = A.scan(index, ids, x, ids[::20], x[::20])
    want = _brute([(i, v) for i, v in enumerate(x)])
    for j, q in enumerate(range(0, 500, 20)):
        assert found[at == j].tolist() == [i for i, _ in want[q]]


def test_pipeline_stages(spark, documents, tmp_path):
    docs, sizes = documents, []
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "simhash_dedup", "source_mix", "packing"]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, "/root/testdata/sf0.001").write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        sizes.append(docs.count())
        if i < 3:  # filters: rows of the input, unchanged
            assert docs.columns == documents.columns
            assert set(map(tuple, docs.collect())) <= set(map(tuple, before.collect()))
        if name == "exact_dedup":
            assert {r.text for r in docs.collect()} == {r.text for r in before.collect()} and docs.count() == docs.select("text").distinct().count()
        if name == "source_mix":
            took = source_mix(before).agg(F.sum("taken")).first()[0]
            assert took == sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in docs.collect())
        if name == "packing":
            assert docs.agg(F.sum("length")).first()[0] == best_fit(before).agg(F.sum("length")).first()[0]
    again = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert sorted(map(tuple, again.select("doc_id", "piece", "length", "ids_crc32").collect())) == sorted(
        map(tuple, docs.select("doc_id", "piece", "length", "ids_crc32").collect()))


def test_pipeline_takes_odd_tables(spark, hostile, empty):
    for table in (hostile, empty):
        docs = table
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, "")
            if name != "packing":
                assert docs.columns == table.columns
        docs.collect()
    assert docs.count() == 0
