"""SimHash near-duplicates through vantage-point trees.

1. Fingerprints: 64 bits over the hashes of all word shingles of a whole text.
   Equal fingerprints are one class from here on; copies are never expanded.
2. Shards: the 64 bits are cut into ``max_bits + 1`` disjoint masks, and a shard is the
   Hamming ball of radius zero around a point in one mask's bits. Two fingerprints at
   most ``max_bits`` apart agree in one of the masks at least, so they meet in that
   mask's shard and no shard has a boundary for others to cross: every fingerprint is
   dealt ``max_bits + 1`` times, whatever the size of the table.
3. A shard of more than ``leaf_points`` fingerprints is cut again in the same way, over
   the bits that its mask leaves: its members agree in the mask, so all their
   differences lie in the rest. Only such shards are dealt once more; at
   ``LAST_BITS`` bits left a shard can hold no more than 2^12 fingerprints. No task
   holds more than the larger of these bounds, and no shard is cut into pairs of
   chunks.
4. Inside a shard a vantage-point tree over all 64 bits finds the exact pairs: within
   a radius goes left, and by the triangle inequality a pair that the radius separates
   lies within ``max_bits`` of it, so only such points are compared across. Points
   within half of ``max_bits`` of a vantage point are linked to it as a star; points
   already known to be connected are not compared any more, so a dense ball costs far
   less than its pairs.
5. A task returns a spanning forest of its links, at most one row per point and
   shard, never all pairs of a group. Components join the forests.

Random fingerprints lie about 32 bits apart give or take 4, so inside a shard the tree
prunes little; the masks do most of the pruning: five masks of 13 bits leave 1/1600 of
all pairs to compare.

Defined cases: a null text has no words, as an empty one; no words give
fingerprint zero, linked like any other; fewer words than a shingle give one
shingle of them all; repeated rows get one row each; an empty table gives none. A
null id is never a component's id unless all its ids are null.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shipfold.llm.common import column, fresh, map_arrow, only, text_slices, without, write_scratch
from shipfold.llm.components import components

SHINGLE = 4
MAX_BITS = 4
SEED = 42
#: Fingerprints of a shard that one task compares; larger ones are cut again.
LEAF_POINTS = 4096
#: A shard with that many bits left is not cut further: it holds at most 2^12 fingerprints.
LAST_BITS = 12
#: Pairs that are compared at once; below that many a task's tree ends.
BLOCK_PAIRS = 1 << 18


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit fingerprint; a bit is set if it is in over half the shingles' hashes."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate([[0], ends[:-1]])[:len(words) - shingle + 1].tolist()
        ends = (ends[shingle - 1:] - 1).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], seed) for a, b in zip(starts, ends, strict=True)]
    bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # bounded memory on very long texts
        part = np.array(hashes[at:at + (1 << 16)], ">u8")
        bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(bits * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, text_col: str, out: str, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with the fingerprint as a signed 64-bit column ``out``."""
    import pyspark.sql.types as T

    names = docs.columns
    at = names.index(text_col)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            got = []
            for _, texts in text_slices(batch, at):
                got += [fingerprint(t, shingle) for t in texts]
            got = pa.array(np.array(got, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, got], names=[*batch.schema.names, out])

    return map_arrow(docs, run, T.StructType([*docs.schema.fields, T.StructField(out, T.LongType())]))


# --- the tree -----------------------------------------------------------------

def distance(points: np.ndarray, vantage) -> np.ndarray:
    return np.bitwise_count(points ^ vantage).astype(np.int16)


def radius(dist: np.ndarray) -> int | None:
    """A radius that leaves points on both sides, near the median; None if none does."""
    lo, hi, mid = int(dist.min()), int(dist.max()), int(np.median(dist))
    return None if lo == hi else min(max(mid, lo), hi - 1)


class Forest:
    """Spanning forest over 0..n-1 that grows by batches of links."""

    def __init__(self, n: int):
        self.root = np.arange(n)
        self.links: list[tuple[int, int]] = []

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.root[a], self.root[b]
            new = ra != rb
            if not new.any():
                return
            a, b, ra, rb = a[new], b[new], ra[new], rb[new]
            hi, lo = np.maximum(ra, rb), np.minimum(ra, rb)
            _, one = np.unique(hi, return_index=True)  # each root moves under one smaller root
            self.links += zip(a[one].tolist(), b[one].tolist(), strict=True)
            self.root[hi[one]] = lo[one]
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up


def link_points(points: np.ndarray, others: np.ndarray | None, max_bits: int) -> list[tuple[int, int]]:
    """Forest links, as indexes, between ``points`` and ``others``, or within ``points``.

    Indexes of ``others`` follow those of ``points``. Sets that one component already
    holds are not compared.
    """
    everything = points if others is None else np.concatenate([points, others])
    forest = Forest(len(everything))
    n = len(points)
    stack = [(np.arange(n), None if others is None else np.arange(n, len(everything)))]
    while stack:
        xs, ys = stack.pop()
        if len(xs) < 2 and ys is None or not len(xs) or ys is not None and not len(ys):
            continue
        first = forest.root[xs[0]]
        if (forest.root[xs] == first).all() and (ys is None or (forest.root[ys] == first).all()):
            continue
        pairs = len(xs) * (len(xs) if ys is None else len(ys))
        r = None
        if pairs > BLOCK_PAIRS and len(xs) > 64:
            for k in range(3):
                at = xs[(len(xs) * (2 * k + 1)) // 6]
                v = everything[at]
                dx = distance(everything[xs], v)
                r = radius(dx)
                if r is not None:
                    near = xs[dx <= max_bits // 2]  # all within max_bits of one another
                    forest.add(near, np.full(len(near), at))
                    break
        if r is None:
            _compare(everything, xs, ys, max_bits, forest)
            continue
        left, right = xs[dx <= r], xs[dx > r]
        near_right = xs[(dx > r) & (dx <= r + max_bits)]
        if ys is None:
            stack += [(left, None), (right, None), (near_right, xs[(dx <= r) & (dx > r - max_bits)])]
        else:
            dy = distance(everything[ys], v)
            stack += [(left, ys[dy <= r + max_bits]), (right, ys[dy > r - max_bits])]
    return forest.links


def _compare(everything: np.ndarray, xs: np.ndarray, ys: np.ndarray | None, max_bits: int, forest: Forest) -> None:
    other = xs if ys is None else ys
    step = max(1, BLOCK_PAIRS // len(other))
    for at in range(0, len(xs), step):
        part = xs[at:at + step]
        i, j = np.nonzero(np.bitwise_count(everything[part][:, None] ^ everything[other][None, :]) <= max_bits)
        a, b = part[i], other[j]
        if ys is None:
            a, b = a[a < b], b[a < b]
        forest.add(a, b)


# --- the joins ----------------------------------------------------------------

def cut_mask(mask: int, parts: int) -> list[int]:
    """The bits that ``mask`` leaves free, cut into ``parts`` runs, each added to ``mask``."""
    free = [b for b in range(64) if not mask >> b & 1]
    edges = [len(free) * k // parts for k in range(parts + 1)]
    return [mask | sum(1 << b for b in free[x:y]) for x, y in zip(edges, edges[1:], strict=False)]


def deal(rows: DataFrame, max_bits: int) -> DataFrame:
    """Rows (mask, part, fp): each row (mask, fp) once per mask that extends its own."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            mask = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            fp = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            for m in np.unique(mask):
                here = fp[mask == m]
                for longer in cut_mask(int(m), max_bits + 1):
                    longer = np.uint64(longer)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(here), longer).view(np.int64)), pa.array((here & longer).view(np.int64)),
                         pa.array(here.view(np.int64))], names=["mask", "part", "fp"])

    return rows.select("mask", "fp").mapInArrow(run, "mask bigint, part bigint, fp bigint")


def shards(classes: DataFrame, max_bits: int, leaf_points: int) -> DataFrame:
    """Rows (mask, part, fp) of shards that a task can hold, all levels together."""
    todo, ready = classes.select(F.lit(0).cast("bigint").alias("mask"), "fp"), []
    while True:
        dealt = write_scratch(deal(todo, max_bits), "simhash-shards")
        hot = write_scratch(
            dealt.groupBy("mask", "part").agg(F.count(F.lit(1)).alias("n"))
            .where((F.col("n") > leaf_points) & (F.bit_count("mask") < 64 - LAST_BITS)).select("mask", "part"), "simhash-hot")
        if hot.isEmpty():
            break
        ready.append(dealt.join(hot, ["mask", "part"], "left_anti"))
        todo = dealt.join(hot, ["mask", "part"], "left_semi")
    for level in ready:
        dealt = dealt.unionByName(level)
    return dealt


def link_shards(dealt: DataFrame, max_bits: int) -> DataFrame:
    """Links (a, b) within each shard; a task reads its shards one after another."""

    def forest(points: np.ndarray) -> list[tuple[int, int]]:
        return [(points[a], points[b]) for a, b in link_points(points, None, max_bits)]

    def run(batches):
        import pyarrow as pa

        def links(pairs):
            a, b = (np.array(x, np.uint64).view(np.int64) for x in (zip(*pairs, strict=True) if pairs else ((), ())))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        key, kept = None, []
        for batch in batches:
            mask, part, fp = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            fp, found = fp.view(np.uint64), []
            new = np.flatnonzero((mask[1:] != mask[:-1]) | (part[1:] != part[:-1])) + 1
            for x, y in zip([0, *new], [*new, len(fp)], strict=True):
                if x == y:
                    continue
                if (mask[x], part[x]) != key:
                    if len(kept) > 1 or kept and len(kept[0]) > 1:
                        found += forest(np.concatenate(kept))
                    key, kept = (mask[x], part[x]), []
                kept.append(fp[x:y])
            yield links(found)
        if kept:
            yield links(forest(np.concatenate(kept)))

    return (dealt.repartition("mask", "part").sortWithinPartitions("mask", "part").select("mask", "part", "fp")
            .mapInArrow(run, "a bigint, b bigint"))


def link_fingerprints(classes: DataFrame, max_bits: int = MAX_BITS, leaf_points: int = LEAF_POINTS) -> DataFrame:
    """Links (a, b) that span every component of distinct fingerprints ``fp``."""
    return link_shards(shards(classes, max_bits, leaf_points), max_bits)


def _roots(rows: DataFrame, id_col: str, max_bits: int, leaf_points: int) -> DataFrame:
    """(fp, component_id): of every distinct fingerprint of rows (id, fp)."""
    classes = write_scratch(rows.groupBy("fp").agg(F.min(id_col).alias("least")), "simhash-classes")
    root = components(link_fingerprints(classes, max_bits, leaf_points))
    named = classes.join(root, F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return named.select("fp", "root").join(least, "root").select("fp", "component_id", "root")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                       max_bits: int = MAX_BITS, leaf_points: int = LEAF_POINTS) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id."""
    d = docs.select(column(docs, id_col).alias("id"), column(docs, text_col).cast("string").alias("text"))
    rows = write_scratch(fingerprints(d, "text", "fp", shingle).select("id", "fp"), "simhash-rows")
    roots = write_scratch(_roots(rows, "id", max_bits, leaf_points), "simhash-roots")
    return rows.join(roots, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0"))
                                         .alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                     max_bits: int = MAX_BITS, leaf_points: int = LEAF_POINTS) -> DataFrame:
    """The rows of ``docs`` that stay, all columns: each component's smallest id, one row.

    Rows are named by id and a hash of their text; a name that is kept and that
    several rows share (repeated rows) keeps one of them.
    """
    text = column(docs, text_col).cast("string")
    keys = [column(docs, id_col), F.xxhash64(text)]
    keyed = docs.select(keys[0].alias("id"), keys[1].alias("hash"), text.alias("text"))
    rows = write_scratch(fingerprints(keyed, "text", "fp", shingle).groupBy("id", "hash", "fp")
                         .agg(F.count(F.lit(1)).alias("n")), "simhash-rows")
    roots = _roots(rows, "id", max_bits, leaf_points).select("fp", "root")
    named = rows.join(roots, "fp")
    first = named.groupBy("root").agg(
        F.min(F.struct(F.col("id").isNull().alias("none"), "id", F.col("hash").isNull().alias("blank"), "hash")).alias("keep"))
    judged = named.join(first, "root").withColumn(
        "stays", F.col("id").eqNullSafe(F.col("keep.id")) & F.col("hash").eqNullSafe(F.col("keep.hash")))
    gone = write_scratch(judged.where(~F.col("stays") | (F.col("n") > 1)).select("id", "hash", "stays"), "simhash-dropped")
    kept = without(docs, keys, gone.select("id", "hash"))
    repeated = gone.where("stays").select("id", "hash")
    if not repeated.isEmpty():
        hash_col = fresh(docs, "text_hash")[0]
        again = only(docs, keys, repeated).withColumn(hash_col, F.xxhash64(text)).dropDuplicates([id_col, hash_col])
        kept = kept.unionByName(again.select(*[column(again, c) for c in docs.columns]))
    return kept
