"""The Merkle manifest against a plain tree and against its SQL."""

import hashlib
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from shipfold.llm import merkle as M

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def _h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _leaf(r, text):
    values = (r.doc_id, r.source, r.lang, r.n_chars, text)
    return _h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def _tree(leaves):
    """(root, per leaf the list of (left, right) sibling texts)."""
    paths, at, nodes = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(nodes) > 1:
        for p, k in zip(paths, at, strict=True):
            run = nodes[k // 8 * 8:k // 8 * 8 + 8]
            p.append(("".join(run[:k % 8]), "".join(run[k % 8 + 1:])))
        nodes = [_h("".join(nodes[k:k + 8])) for k in range(0, len(nodes), 8)]
        at = [k // 8 for k in at]
    return nodes[0], paths


def _expected(rows):
    groups = defaultdict(list)
    for r in rows:
        used = _leaf(r, r.text)
        if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0 and r.text is not None:
            used = _leaf(r, "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text))
        groups[r.lang].append((r.doc_id is not None, r.doc_id or 0, _leaf(r, r.text), used))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: _tree([x[2] for x in sorted(groups[g])]) for g in names}
    root, tops = _tree([trees[g][0] for g in names])
    out = Counter()
    for g, top in zip(names, tops, strict=True):
        for (known, doc_id, leaf, used), path in zip(sorted(groups[g]), trees[g][1], strict=True):
            path = path + top
            folded = used
            for a, b in path:
                folded = _h(a + folded + b)
            proof = _h("".join(a + b for a, b in path))
            out[(doc_id if known else None, leaf, trees[g][0], root, proof, folded, folded == root)] += 1
    return out


def _got(docs):
    df = M.manifest(docs, M.every_third(docs))
    assert df.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return Counter(map(tuple, df.collect()))


def test_manifest_matches_a_plain_tree(hostile, documents, empty):
    for docs in (hostile, documents):
        want = _expected(docs.collect())
        assert _got(docs) == want
        assert {k[-1] for k in want} == {True, False}
    assert not _got(empty)


@pytest.mark.parametrize("n", [1, 2, 8, 9, 65, 513])
def test_rounds_over_small_blocks(spark, monkeypatch, n):
    """Several rounds of subtrees, in the languages' trees and in the tree of languages."""
    monkeypatch.setattr(M, "HEIGHT", 1)
    rows = [(i * 7 % 1000, f"Text {i}", "hot" if i % 3 else f"l{i % 40}", None, i) for i in range(n)]
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    assert _got(docs) == _expected(docs.collect())


def test_many_repeated_rows_are_leaves_of_their_own(spark):
    docs = spark.createDataFrame([(5, "Same", "en", "s", 4)] * 700 + [(6, "Other", "en", "s", 5)], DOCS).repartition(6)
    assert _got(docs) == _expected(docs.collect())


def test_addresses_are_the_van_emde_boas_order():
    for levels in range(1, 6):
        every = np.concatenate([M.address(levels, d, np.arange(8 ** d)) for d in range(levels)])
        assert sorted(every) == list(range(M.tree_size(levels)))
    # Five levels: two above, then 64 subtrees of three levels, one after another.
    assert M.address(5, 1, np.arange(8)).tolist() == list(range(1, 9))
    assert M.address(5, 2, np.arange(64)).tolist() == [9 + 73 * k for k in range(64)]
    low = M.address(5, 4, np.arange(4096))
    assert ((low - 9) // 73 == np.arange(4096) // 64).all()


def test_proofs_by_address_verify_and_tampering_shows():
    leaves = [hashlib.sha256(bytes([k % 251, k // 251])).digest() for k in range(1000)]
    tree = M.build(leaves, M.HEIGHT)
    levels = M.runs(tree, M.HEIGHT, len(leaves))
    for k in (0, 7, 8, 511, 999):
        assert M.fold(leaves[k].hex(), *M.siblings(levels, k)) == tree[:32].hex()
        assert M.fold(leaves[k - 1].hex(), *M.siblings(levels, k)) != tree[:32].hex()


def test_sql_gives_the_same(spark, documents):
    con = duckdb.connect()
    con.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    want = Counter(con.sql(f"SELECT {', '.join(names)} FROM ({M.oracle()})").fetchall())
    assert _got(documents) == want
