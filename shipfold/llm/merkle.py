"""A Merkle manifest of a dataset in van Emde Boas blocks.

Every row is a leaf, a SHA-256 of its columns. Per group (language) the leaves in id
order form a tree of eight children a node; the groups' roots form one more.

1. Leaves are digested in the JVM and written. A range partitioning by (group, id,
   leaf, row) and a running count per partition give every leaf its position in its
   group; no group is ever one task.
2. The tree is cut into aligned subtrees of ``HEIGHT`` levels of edges (4,096 leaves).
   Each is one row whose digests lie in one byte string in van Emde Boas order:
   the upper half of the levels first, then each lower subtree, recursively.
   ``address`` computes a node's place from its depth and index alone; building and
   reading both go by it, so no node stores a pointer.
3. The subtrees' roots are the leaves of the next round, until each group has one
   root; the groups' roots go through the same rounds. A round is written to the
   shared folder: a lost executor repeats a part of one round.
4. Proofs come back down: the subtree of a round hands each leaf's siblings, found by
   address, to the subtree below it. One row a subtree moves, not one a leaf.
   The last step folds each leaf (or its tampered copy) with its siblings up to the root.

Defined cases: a null column is ``-`` in the leaf; null ids come first and count as not
tampered; repeated rows are leaves of their own, equal ones next to each other; a null
group is a group of its own, the first; an empty table gives no rows. Further columns
are never read.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shipfold.llm.common import column, map_arrow, write_scratch

#: Children of a node.
ARITY = 8
#: Levels of edges of an aligned subtree: one task handles 8^4 leaves.
HEIGHT = 4
#: The columns a leaf covers, in order.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


# --- the layout ---------------------------------------------------------------

def tree_size(levels: int) -> int:
    """Nodes of a full tree of so many levels of nodes."""
    return (ARITY ** levels - 1) // (ARITY - 1)


def address(levels: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Place of the nodes ``index`` of a depth in a full tree's van Emde Boas order."""
    if levels == 1:
        return np.zeros_like(index)
    top = levels // 2
    if depth < top:
        return address(top, depth, index)
    below = ARITY ** (depth - top)
    lower = levels - top
    return tree_size(top) + index // below * tree_size(lower) + address(lower, depth - top, index % below)


@lru_cache(maxsize=64)
def _places(levels: int, depth: int) -> np.ndarray:
    return address(levels, depth, np.arange(ARITY ** depth))


def height_of(n: int) -> int:
    """Levels of edges until n leaves have one root."""
    h = 0
    while n > 1:
        n, h = -(-n // ARITY), h + 1
    return h


def build(leaves: list[bytes], height: int) -> bytes:
    """The digests of an aligned subtree over its leaves, in van Emde Boas order.

    Nodes that a partial subtree lacks are zero. The root is the first digest.
    """
    tree = np.zeros((tree_size(height + 1), 32), np.uint8)
    nodes = leaves
    for depth in range(height, -1, -1):
        tree[_places(height + 1, depth)[:len(nodes)]] = np.frombuffer(b"".join(nodes), np.uint8).reshape(-1, 32)
        if depth:
            text = [d.hex() for d in nodes]
            nodes = [hashlib.sha256("".join(text[k:k + ARITY]).encode()).digest() for k in range(0, len(text), ARITY)]
    return tree.tobytes()


def runs(tree: bytes, height: int, n: int) -> list[list[str]]:
    """Per level of edges, lowest first: the digests of each run of siblings, as hex text."""
    at = np.frombuffer(tree, np.uint8).reshape(-1, 32)
    out = []
    for depth in range(height, 0, -1):
        count = -(-n // ARITY ** (height - depth))
        text = at[_places(height + 1, depth)[:count]].tobytes().hex()
        out.append([text[k:k + 64 * ARITY] for k in range(0, len(text), 64 * ARITY)])
    return out


def siblings(levels: list[list[str]], leaf: int) -> tuple[list[str], list[str]]:
    """What stands left and right of a leaf's ancestors in their runs, lowest level first."""
    left, right = [], []
    for run in levels:
        text, at = run[leaf // ARITY], leaf % ARITY * 64
        left.append(text[:at])
        right.append(text[at + 64:])
        leaf //= ARITY
    return left, right


def fold(leaf: str, left: list[str], right: list[str]) -> str:
    """The root that a leaf and its siblings give."""
    for a, b in zip(left, right, strict=True):
        leaf = hashlib.sha256((a + leaf + b).encode()).hexdigest()
    return leaf


# --- the rounds ---------------------------------------------------------------

def leaf_digest(docs: DataFrame, text: Column) -> Column:
    """SHA-256 of the leaf's columns, each ``-`` or its length in bytes, ``:`` and its value."""

    def part(value: Column) -> Column:
        value = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*[part(text if c == "text" else column(docs, c)) for c in COLUMNS]), 256)


def positions(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """``rows`` written with ``pos``, the row's place in its (non-null) group, and ``n``, the group's rows."""
    keys = [group, *order]
    placed = write_scratch(rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
                           .withColumn("at", F.monotonically_increasing_id()), name)
    placed = placed.withColumn("slice", F.shiftright("at", 33))
    by = Window.partitionBy(group)
    starts = (placed.groupBy(group, "slice").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("size"))
              .withColumn("n", F.sum("size").over(by))
              .withColumn("before", F.sum("size").over(by.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))))
    return (placed.join(starts, [group, "slice"])
            .withColumn("pos", F.col("at") - F.col("first") + F.coalesce("before", F.lit(0)))
            .drop("at", "slice", "first", "size", "before"))


BLOCK = "g string, block bigint, n bigint, ids array<bigint>, used array<binary>, size int, height int, tree binary"


def subtrees(nodes: DataFrame, name: str) -> DataFrame:
    """One written row per aligned subtree of nodes (g, pos, n, digest, id, used)."""
    span = ARITY ** HEIGHT
    grouped = (nodes.groupBy("g", F.floor(F.col("pos") / span).alias("block"))
               .agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("pos", "id", "digest", "used"))).alias("nodes")))
    grouped = grouped.select("g", "block", "n", F.col("nodes.id").alias("ids"), F.col("nodes.used").alias("used"),
                             F.col("nodes.digest").alias("digests"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            heights, trees, sizes = [], [], []
            for n, digests in zip(batch.column(2).to_pylist(), batch.column(5).to_pylist(), strict=True):
                h = height_of(n) if n <= span else HEIGHT
                heights.append(h)
                sizes.append(len(digests))
                trees.append(build(digests, h))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sizes, pa.int32()), pa.array(heights, pa.int32()), pa.array(trees, pa.binary())],
                names=["g", "block", "n", "ids", "used", "size", "height", "tree"])

    return write_scratch(map_arrow(grouped, run, BLOCK), name)


def rounds(nodes: DataFrame, name: str) -> list[DataFrame]:
    """The subtrees of each round, lowest first, until every group has one root."""
    span, out = ARITY ** HEIGHT, []
    while True:
        blocks = subtrees(nodes, name)
        out.append(blocks)
        above = blocks.where(F.col("n") > span)
        if above.isEmpty():
            return out
        nodes = above.select("g", F.col("block").alias("pos"), F.ceil(F.col("n") / span).alias("n"),
                             F.substring("tree", 1, 32).alias("digest"), F.lit(None).cast("bigint").alias("id"),
                             F.lit(None).cast("binary").alias("used"))


def _tops(blocks: DataFrame) -> DataFrame:
    return blocks.where(F.col("n") <= ARITY ** HEIGHT)


PATH = "g string, block bigint, above_left array<string>, above_right array<string>, subroot string"


def hand_down(blocks: DataFrame, paths: DataFrame) -> DataFrame:
    """Paths (PATH) of the subtrees below ``blocks``, whose own paths are given."""
    joined = blocks.select("g", "block", "size", "height", "tree").join(paths, ["g", "block"])
    span = ARITY ** HEIGHT

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for r in batch.to_pylist():
                levels = runs(r["tree"], r["height"], r["size"])
                out = []
                for k in range(r["size"]):
                    left, right = siblings(levels, k)
                    out.append((left + r["above_left"], right + r["above_right"]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["g"]] * len(out), pa.string()), pa.array(np.arange(len(out)) + r["block"] * span, pa.int64()),
                     pa.array([x for x, _ in out], pa.list_(pa.string())), pa.array([y for _, y in out], pa.list_(pa.string())),
                     pa.array([r["subroot"]] * len(out), pa.string())],
                    names=["g", "block", "above_left", "above_right", "subroot"])

    return map_arrow(joined.select("g", "block", "size", "height", "tree", "above_left", "above_right", "subroot"), run, PATH)


def _descend(levels: list[DataFrame], start: DataFrame) -> DataFrame:
    """Paths of the lowest round's subtrees; ``start`` has (g, above_left, above_right, subroot) per group."""
    paths = None
    for k in range(len(levels) - 1, -1, -1):
        tops = (_tops(levels[k]).select("g", "block").join(start, "g")
                .select("g", "block", "above_left", "above_right", "subroot"))
        paths = tops if paths is None else tops.unionByName(hand_down(levels[k + 1], paths))
        paths = write_scratch(paths, "merkle-paths")
    return paths


def _last(blocks: DataFrame, paths: DataFrame, root: str, id_type: str) -> DataFrame:
    """One row per leaf: its proof folded to the root."""
    joined = blocks.join(paths, ["g", "block"]).select("ids", "used", "size", "height", "tree", "above_left", "above_right", "subroot")
    out = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for r in batch.to_pylist():
                levels = runs(r["tree"], r["height"], r["size"])
                text = "".join(levels[0]) if levels else r["tree"][:32].hex()
                leaf, proof, folded = [], [], []
                for k in range(r["size"]):
                    left, right = siblings(levels, k)
                    left, right = left + r["above_left"], right + r["above_right"]
                    leaf.append(text[64 * k:64 * k + 64])
                    beside = "".join([x for pair in zip(left, right, strict=True) for x in pair])
                    proof.append(hashlib.sha256(beside.encode()).hexdigest())
                    folded.append(fold(r["used"][k].hex() if r["used"][k] else leaf[-1], left, right))
                n = r["size"]
                cols = [pa.array(r["ids"], pa.int64()), pa.array(leaf), pa.array([r["subroot"]] * n), pa.array([root] * n),
                        pa.array(proof), pa.array(folded), pa.array([f == root for f in folded])]
                yield pa.RecordBatch.from_arrays(cols, names=list(out))

    return map_arrow(joined, run, "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, "
                                  "folded_root string, verified boolean")


def manifest(docs: DataFrame, tampered: Column, id_col: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: leaf, subroot, root, proof digest, folded root, verified.

    ``tampered`` marks rows whose text counts as lower-cased (A-Z) when the proof is folded.
    The ids are integers.
    """
    text = column(docs, "text").cast("string")
    lang = column(docs, "lang").cast("string")
    group = F.when(lang.isNull(), "-").otherwise(F.concat(F.lit("+"), lang))
    leaf = leaf_digest(docs, text)
    used = F.when(tampered & text.isNotNull(), leaf_digest(docs, F.translate(text, UPPER, LOWER)))
    leaves = write_scratch(docs.select(group.alias("g"), lang.alias("lang"), column(docs, id_col).cast("bigint").alias("id"),
                                       F.unhex(leaf).alias("digest"), F.unhex(used).alias("used"))
                           .withColumn("row", F.monotonically_increasing_id()), "merkle-leaves")
    nodes = positions(leaves.drop("lang"), "g", ["id", "digest", "row"], "merkle-order")
    levels = rounds(nodes, "merkle-blocks")

    # The groups' roots, in the order of the languages, form a tree of their own.
    roots = None
    for blocks in levels:
        part = _tops(blocks).select("g", F.substring("tree", 1, 32).alias("digest"))
        roots = part if roots is None else roots.unionByName(part)
    langs = leaves.select("g", "lang").distinct().join(roots, "g")
    ranked = write_scratch(positions(langs.select(F.col("g").alias("name"), "lang", "digest", F.lit("").alias("g")), "g", ["lang"],
                                     "merkle-langs"), "merkle-ranks")
    upper = rounds(ranked.select("g", "pos", "n", "digest", F.lit(None).cast("bigint").alias("id"),
                                 F.lit(None).cast("binary").alias("used")), "merkle-upper")
    none = F.array().cast("array<string>")
    top = _tops(upper[-1]).select(F.lower(F.hex(F.substring("tree", 1, 32)))).first()
    root = top[0] if top else ""
    start = _tops(upper[-1]).select("g", none.alias("above_left"), none.alias("above_right"),
                                    F.lit(root).alias("subroot"))
    lang_paths = hand_down(upper[0], _descend(upper, start))
    starts = (ranked.join(lang_paths.select(F.col("block").alias("pos"), "above_left", "above_right"), "pos")
              .select(F.col("name").alias("g"), "above_left", "above_right", F.lower(F.hex("digest")).alias("subroot")))
    paths = _descend(levels, write_scratch(starts, "merkle-starts"))
    return _last(levels[0], paths, root, "bigint")


def every_third(docs: DataFrame, id_col: str = "doc_id") -> Column:
    """Whether 3 divides the unsigned crc32 of the decimal id; a null id is not."""
    return F.coalesce(F.crc32(column(docs, id_col).cast("string").cast("binary")) % 3 == 0, F.lit(False))


# --- the same in SQL ----------------------------------------------------------

def _sql_leaf(text: str) -> str:
    parts = ["coalesce(strlen({0}) || ':' || {0}, '-')".format(text if c == "text" else f"CAST({c} AS VARCHAR)") for c in COLUMNS]
    return "sha256(" + " || ".join(parts) + ")"


#: Unsigned crc32 of decimal digits, by its definition: eight steps a byte.
_SQL_CRC = """xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
    lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)),
                               lambda x, k: xor(x >> 1, (x & 1) * 3988292384))))"""


def _sql_rounds(nodes: str, docs: str, tag: str, count: int) -> str:
    """CTEs that take nodes (g, i, h, n) and docs (.., g, i, f, proof) up ``count`` levels."""
    out = []
    for k in range(count):
        a, b = (f"{nodes}", f"{docs}") if k == 0 else (f"n_{tag}{k}", f"d_{tag}{k}")
        out.append(f"""
        r_{tag}{k} AS (SELECT g, i // 8 AS i, string_agg(h, '' ORDER BY i) AS r, max(n) AS n FROM {a} GROUP BY g, i // 8),
        n_{tag}{k + 1} AS (SELECT g, i, CASE WHEN n > 1 THEN sha256(r) ELSE r END AS h, (n + 7) // 8 AS n FROM r_{tag}{k}),
        d_{tag}{k + 1} AS (
            SELECT d.* EXCLUDE (i, f, proof), d.i // 8 AS i,
                   CASE WHEN n > 1 THEN sha256(r[:d.i % 8 * 64] || f || r[d.i % 8 * 64 + 65:]) ELSE f END AS f,
                   proof || CASE WHEN n > 1 THEN r[:d.i % 8 * 64] || r[d.i % 8 * 64 + 65:] ELSE '' END AS proof
            FROM {b} d JOIN r_{tag}{k} r ON d.g IS NOT DISTINCT FROM r.g AND d.i // 8 = r.i)""")
    return ",".join(out)


def oracle(levels: int = 7, lang_levels: int = 3) -> str:
    """DuckDB SQL of the manifest, for up to 8^levels rows a language and 8^lang_levels languages."""
    return f"""
    WITH leaves AS (
        SELECT doc_id, lang AS g, {_sql_leaf("text")} AS leaf,
               CASE WHEN {_SQL_CRC} % 3 = 0
                    THEN {_sql_leaf(f"translate(text, '{UPPER}', '{LOWER}')")} END AS used
        FROM documents),
    d_a AS (SELECT doc_id, leaf, g, coalesce(used, leaf) AS f, '' AS proof,
                   row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM leaves),
    n_a AS (SELECT g, i, leaf AS h, count(*) OVER (PARTITION BY g) AS n FROM d_a),
    {_sql_rounds("n_a", "d_a", "a", levels)},
    l AS (SELECT g, h AS subroot, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS i FROM n_a{levels}),
    n_b AS (SELECT 0 AS g, i, subroot AS h, count(*) OVER () AS n FROM l),
    d_b AS (SELECT d.doc_id, d.leaf, l.subroot, d.f, d.proof, l.i, 0 AS g
            FROM d_a{levels} d JOIN l ON d.g IS NOT DISTINCT FROM l.g),
    {_sql_rounds("n_b", "d_b", "b", lang_levels)}
    SELECT d.doc_id, d.leaf, d.subroot, n.h AS root, sha256(d.proof) AS proof_sha256, d.f AS folded_root, d.f = n.h AS verified
    FROM d_b{lang_levels} d, n_b{lang_levels} n"""
