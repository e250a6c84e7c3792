"""Source mix and packing against brute force and exact round trips."""

import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from shipfold.llm import best_fit as B
from shipfold.llm import source_mix as M


def _targets(sizes):
    """The rule itself: share by weight, cap, share the excess again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total = sum(sizes.values())
    target, capped = {}, set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(3 * sizes[s] for s in capped)
        w = sum(weight[s] for s in free)
        target = {s: 3.0 * sizes[s] if s in capped else left * weight[s] / w for s in names}
        over = {s for s in free if target[s] > 3 * sizes[s]}
        if not over:
            return target
        capped |= over


def _check_mix(docs, slack):
    got = M.source_mix(docs).collect()
    size = defaultdict(int)
    rows = docs.collect()
    for r in rows:
        size[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    target = _targets(dict(size))
    assert len(got) == len(rows)
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    by_target = defaultdict(int)
    for r in got:
        by_target[(r.source_size, round(r.target, 3))] += r.taken
    want = defaultdict(float)
    for s, t in target.items():
        want[(size[s], round(t, 3))] += t
    assert set(by_target) == set(want)
    assert all(abs(by_target[k] - want[k]) <= slack * want[k] + 2 * M.BLOCK_WORDS for k in want)
    return got


def test_mix_meets_its_targets(documents, hostile):
    got = _check_mix(documents, 0.05)
    assert sorted(got) == sorted(M.source_mix(documents).collect())  # reruns agree
    _check_mix(hostile, 0.05)


def test_capped_sources_and_plain_multinomial(spark):
    rows = [(i, "w " * (5 if i % 50 else 4000), None, f"s{i % 50:02d}", 1) for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = _check_mix(docs, 0.02)
    assert max(r.taken / r.size for r in got) == 3
    plain = M.source_mix(docs, stratified=False).agg(F.sum("taken"), F.sum("size")).first()
    assert abs(plain[0] - plain[1]) < 0.1 * plain[1]


def test_each_source_meets_its_target_by_multinomial_draws(spark):
    """Sources of many sizes; every shard's counts vary as draws do, and every source comes near its target."""
    rows = [(i, "w " * (20 + i % 90), None, f"s{min(i % 40, 9)}", 1) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    _check_mix(docs, 0.01)
    d = M._rows(docs, "doc_id", "text", "source", F.monotonically_increasing_id())
    _, sources, taken = M._plan(d, M.BLOCK_WORDS, M.SHARD_SLOTS, M.MAX_REPEAT, False)
    share = {r.sid: r.slots for r in sources.collect()}
    got = defaultdict(dict)
    for r in taken.groupBy("shard", "sid").count().collect():
        got[r.shard][r.sid] = r["count"]
    total = sum(share.values())
    big = max(share, key=share.get)
    p, n = share[big] / total, total / M.MIN_SHARDS
    counts = np.array([got[k].get(big, 0) for k in range(M.MIN_SHARDS // 2)])  # the first wave: independent draws
    assert 0.4 < counts.var() / (n * p * (1 - p)) < 2 and abs(counts.mean() - n * p) < 0.1 * n * p


def test_mix_of_nothing(spark, empty):
    assert M.source_mix(empty).count() == 0 and M.mixed_documents(empty).count() == 0
    blank = spark.createDataFrame([(1, None, None, None, 0), (2, " ", None, "a", 1)], empty.schema)
    assert [(r.taken, r.target) for r in M.source_mix(blank).collect()] == [(0, 0.0)] * 2


@pytest.mark.parametrize("n", [1, 2, 7, 1000])
def test_permutation_is_one(spark, n):
    df = spark.range(n).select(*[M.permute(F.col("id"), F.lit(n), F.lit(k)).alias(f"p{k}") for k in range(2)])
    got = np.array([tuple(r) for r in df.collect()])
    assert all(sorted(got[:, k]) == list(range(n)) for k in range(2))
    assert n < 1000 or (got[:, 0] != got[:, 1]).mean() > 0.9 and (np.diff(got[:, 0]) == 1).mean() < 0.1


def test_mixed_documents_hold_what_the_mix_takes(documents, hostile):
    for docs in (documents, hostile):
        mixed = M.mixed_documents(docs)
        assert mixed.columns == docs.columns

        def words(df):
            return df.groupBy("doc_id").agg(F.sum(M.word_count(F.col("text"))).alias("n"))
        got = {r.doc_id: r.n for r in words(mixed).collect()}
        want = {r.doc_id: r.n for r in M.source_mix(docs).groupBy("doc_id").agg(F.sum("taken").alias("n")).collect() if r.n}
        assert got == want
        texts = {(r.doc_id, " ".join((r.text or "").split())) for r in docs.collect()}
        for r in mixed.collect():
            assert r.n_chars == len(r.text)
            assert any(i == r.doc_id and (r.text in t or len(r.text) < len(t) or " ".join(r.text.split()) == t) for i, t in texts)


def _library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file("/opt/tokenizers/word_bpe_49k.json")


def test_word_ids_are_the_librarys(hostile, documents):
    texts = [r.text or "" for r in (*hostile.collect(), *documents.collect())]
    texts += ["don't WE'LL x's", "<|startoftext|>a<|endoftext|>", "Å é ́x  　z", "a" * 5000 + ".", "\"(a)\"",
              "İ ı ſ K ß ﬁ", "tab\x0b\x0c\x1c\x85x", "x%%% &&& ***"]
    words, lib = B.WordIds("/opt/tokenizers/word_bpe_49k.json"), _library()
    got = words.ids([t.encode() for t in texts])
    assert [g.tolist() for g in got] == [lib.encode(t, add_special_tokens=False).ids for t in texts]


def test_word_memory_stays_bounded(monkeypatch):
    monkeypatch.setattr(B, "REMEMBERED", 50)
    monkeypatch.setattr(B, "KEPT", 20)
    words, lib = B.WordIds("/opt/tokenizers/word_bpe_49k.json"), _library()
    texts = [" ".join(f"w{(i * 37 + j) % 400} {'long' * 20}{j}" for j in range(30)) for i in range(40)]
    for t in texts:
        assert words.ids([t.encode()])[0].tolist() == lib.encode(t, add_special_tokens=False).ids
        assert words.n <= 50 + 60


def test_packing_is_an_exact_round_trip(hostile, documents, empty):
    lib = _library()
    for docs in (hostile, documents):
        rows = docs.collect()
        want = []
        for r in rows:
            ids = np.array([*lib.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
            want += [(r.doc_id, i // 2048, i, len(ids[i:i + 2048]), zlib.crc32(ids[i:i + 2048].tobytes()))
                     for i in range(0, len(ids), 2048)]
        packed = B.best_fit(docs)
        assert packed.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
        got = packed.collect()
        key = lambda x: tuple((v is None, v) for v in x)
        assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want, key=key)
        seqs = defaultdict(list)
        for r in got:
            seqs[r.sequence_id].append((r.offset, r.length))
        for parts in seqs.values():
            at = 0
            for off, n in sorted(parts):
                assert off == at
                at += n
            assert at <= 2048
        total = sum(w[3] for w in want)
        assert len(seqs) <= -(-total // 2048) + 2
    assert B.best_fit(empty).count() == 0


def test_sum_of_squares_places_as_its_rule_says():
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 13, 300)
    seq, off = B.sum_of_squares(lengths, 12)
    level, count = {}, [0] * 13
    for s, b, o in zip(lengths.tolist(), seq.tolist(), off.tolist(), strict=True):
        def after(g):
            c = list(count)
            if g < 12:
                c[g] -= 1
            if g > s:
                c[g - s] += 1
            return sum(x * x for x in c[1:12])
        best = min(after(g) for g in range(s, 13) if g == 12 or count[g])
        g = 12 - level.get(b, 0)
        assert o == level.get(b, 0) and after(g) == best
        if g < 12:
            count[g] -= 1
        if 0 < g - s:
            count[g - s] += 1
        level[b] = o + s
