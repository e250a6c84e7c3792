"""Exact dedup and SimHash near-duplicates against brute force."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

from shipfold.llm import simhash_vp as S
from shipfold.llm.components import components
from shipfold.llm.exact_dedup import exact_dedup, keep_first_copies


def _expected(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r.text or ""].append(r.doc_id)
    out = Counter()
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256(text.encode()).hexdigest()
        left = [keep]  # one row of the winner's is kept
        for i in ids:
            kept = i in left
            if kept:
                left.remove(i)
            out[(i, keep, len(ids), kept, sha)] += 1
    return out


def test_exact_dedup_matches_brute_force(spark, hostile, documents, empty):
    for docs in (hostile, documents):
        got = exact_dedup(docs)
        assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
        assert Counter(map(tuple, got.collect())) == _expected(docs.collect())
    assert exact_dedup(empty).count() == 0


def test_exact_dedup_splits_hot_groups(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"text {i % 900}", "en", "s", 3) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(7)
    got = exact_dedup(docs, tracked=64, max_heavy=4)
    assert Counter(map(tuple, got.collect())) == _expected(docs.collect())


def test_kept_rows_are_whole_and_one_a_text(hostile, documents, empty):
    for docs in (hostile, documents):
        kept, rows = keep_first_copies(docs), docs.collect()
        assert kept.columns == docs.columns
        got = kept.collect()
        assert Counter((r.text or "") for r in got) == Counter({(r.text or ""): 1 for r in rows})
        most = {}
        for r in rows:
            most[r.text or ""] = max(most.get(r.text or "", -1), -1 if r.doc_id is None else r.doc_id)
        assert all((-1 if r.doc_id is None else r.doc_id) == most[r.text or ""] for r in got)
        assert all(tuple(r) in set(map(tuple, rows)) for r in got)
    assert keep_first_copies(empty).count() == 0


def _fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def _components(fps):
    """Component number of each fingerprint, all pairs compared."""
    u, inverse = np.unique(np.array(fps, np.uint64), return_inverse=True)
    root = list(range(len(u)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(u)):
        for j in np.flatnonzero(np.bitwise_count(u ^ u[i]) <= 4):
            root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in inverse]


def test_simhash_components_match_brute_force(hostile, documents, empty):
    for docs in (hostile, documents):
        rows = docs.collect()
        fps = [_fingerprint(r.text) for r in rows]
        least = defaultdict(list)
        comps = _components(fps)
        for c, r in zip(comps, rows, strict=True):
            if r.doc_id is not None:
                least[c].append(r.doc_id)
        want = Counter((r.doc_id, f"{f:016x}", min(least[c], default=None)) for r, f, c in zip(rows, fps, comps, strict=True))
        got = S.simhash_components(docs, leaf_points=8)
        assert got.columns == ["doc_id", "fingerprint", "component_id"]
        assert Counter(map(tuple, got.collect())) == want
    assert S.simhash_components(empty).count() == 0


def test_one_row_of_each_component_stays(hostile, documents, empty):
    for docs in (hostile, documents):
        rows = docs.collect()
        comps = _components([_fingerprint(r.text) for r in rows])
        of = {tuple(r): c for r, c in zip(rows, comps, strict=True)}
        kept = S.keep_one_of_each(docs, leaf_points=8)
        assert kept.columns == docs.columns
        assert sorted(of[tuple(r)] for r in kept.collect()) == sorted(set(comps))
    assert S.keep_one_of_each(empty).count() == 0


def _points(seed=0, n=3000):
    rng = np.random.default_rng(seed)
    points = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, n, dtype=np.uint64)
    near = [points]
    for _ in range(4):  # chains of near copies, and one dense ball
        flips = np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (3, 300)).astype(np.uint64))
        near.append(near[-1][:300] ^ flips)
    ball = points[0] ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64))
    return np.unique(np.concatenate([*near, ball]))


def test_tree_join_links_what_all_pairs_link(spark, monkeypatch):
    points = _points()
    comps = _components(points)
    monkeypatch.setattr(S, "BLOCK_PAIRS", 1 << 12)
    links = S.link_points(points, None, 4)
    forest = S.Forest(len(points))
    forest.add(*(np.array(x) for x in zip(*links, strict=True)))
    assert len(links) == len(points) - len(set(comps))
    assert len({(a, b) for a, b in zip(comps, forest.root.tolist(), strict=True)}) == len(set(comps))


def test_sharded_tree_links_what_all_pairs_link(spark):
    points = _points(1, 1500)
    comps = dict(zip(points.view(np.int64).tolist(), _components(points), strict=True))
    classes = spark.createDataFrame([(x,) for x in points.view(np.int64).tolist()], "fp long")
    for leaf in (64, 700):
        links = S.link_fingerprints(classes, 4, leaf).collect()
        assert all(comps[a] == comps[b] for a, b in links)
        root = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
        seen = {(comps[p], root.get(p, p)) for p in comps}
        assert len(seen) == len(set(comps.values()))


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(100, 400)] + [(7, i) for i in range(1000, 1400)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(100, 401), 100), **dict.fromkeys([7, *range(1000, 1400)], 7)}


def test_each_fingerprint_is_dealt_once_per_mask(spark):
    points = _points(2, 2500)
    classes = spark.createDataFrame([(x,) for x in points.view(np.int64).tolist()], "fp long")
    assert S.shards(classes, 4, 4096).count() == 5 * len(points)


def test_dense_shards_are_cut_and_stay_whole(spark):
    """Thousands of fingerprints around one point, most of them in one shard of every mask."""
    rng = np.random.default_rng(3)
    flips = [np.uint64(1) << rng.integers(0, 64, 5000).astype(np.uint64) for _ in range(5)]
    points = np.unique(np.bitwise_xor.reduce(flips) ^ np.uint64(0x0123456789ABCDEF))
    comps = dict(zip(points.view(np.int64).tolist(), _components(points), strict=True))
    classes = spark.createDataFrame([(x,) for x in points.view(np.int64).tolist()], "fp long")
    dealt = S.shards(classes, 4, 128)
    for r in dealt.groupBy("mask", "part").count().collect():  # as many as free bits allow at the last cut
        assert r["count"] <= 128 or (r["mask"] & (1 << 64) - 1).bit_count() >= 64 - S.LAST_BITS
    root = {r.node: r.root for r in components(S.link_shards(dealt, 4)).collect()}
    assert len({(comps[p], root.get(p, p)) for p in comps}) == len(set(comps.values()))
