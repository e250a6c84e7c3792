"""Approximate nearest neighbours by an adaptive dimension scan.

Vectors get one more component that makes all norms equal, so that the nearest in
distance has the largest inner product; a random rotation then spreads every vector's
length evenly over the components. Lists are k-means cells fitted on a sample of at
most ``SAMPLE`` vectors; every vector is in one list. How many lists a query probes is
measured on the sample: the fewest that hold ``RECALL`` of the true neighbours there,
and at least enough to hold ``k`` candidates.

Within a probed list, distances grow by blocks of ``COLUMNS`` components. After the first
block the ``FIRST`` * k candidates nearest so far get their whole distance, the k-th
of which is the first bound. After each block, a candidate is abandoned if its partial
distance, scaled up to all D components from the d seen, exceeds (1 + EPSILON / sqrt(d))^2
times the bound: the hypothesis that it is nearer is then rejected. Survivors get
their exact inner product on the original vectors, in double precision.

Every vector goes to one chunk of at most about ``CHUNK_ROWS`` vectors of its list, once;
only queries are copied, to the chunks of the lists that they probe. A task holds one
chunk and reads the queries that ask it one Arrow batch after another, so its memory
does not grow with their number. A chunk returns ``k`` rows a query at most. Lists grow
with the square root of the vectors, up to ``MAX_LISTS``.

Defined cases: vectors null, empty, zero, with null or non-finite components, or of
another length than most take no part, neither do null ids; repeated ids are rows of
their own, and a query never meets a row of its own id; ties go to the smaller id; an
empty table, or one without queries, gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shipfold.llm.common import column, map_arrow, write_scratch

K = 20
SAMPLE = 16_384
SAMPLE_QUERIES = 256
MAX_LISTS = 4096
#: Rows whose distances to all centres are held at once.
CENTRE_ROWS = 2048
RECALL = 0.97
COLUMNS = 16
EPSILON = 1.2
FIRST = 2
CHUNK_ROWS = 8192
#: Below this share of living pairs, blocks of columns are added pair by pair.
SPARSE = 0.6
#: Room for single precision in the comparisons of partial distances.
SLACK = 1e-4
SEED = 11


def valid_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec array<double>) of the rows that take part."""
    v = df.select(column(df, id_col).cast("long").alias("id"), column(df, vec_col).cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    v = v.where(F.col("id").isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists("vec", lambda x: x != 0))
    usual = v.groupBy(F.size("vec").alias("n")).count().orderBy(F.col("count").desc(), "n").first()
    return v.where(F.size("vec") == (usual["n"] if usual else 0))


class Index:
    """Rotation and lists; small enough to go with every task."""

    def __init__(self, sample: np.ndarray, norm: float, rows: int, k: int, recall: float):
        rng = np.random.default_rng(SEED)
        d = sample.shape[1] + 1
        self.norm = norm
        self.rotation = np.linalg.qr(rng.standard_normal((d, d)))[0]
        lists = min(MAX_LISTS, max(1, math.ceil(math.sqrt(rows) / 4)), len(sample))
        x = self.rotated(sample, True)
        self.centres = x[rng.choice(len(x), lists, replace=False)].copy()
        for _ in range(10):
            of = self.nearest(x)
            sums = np.zeros_like(self.centres)
            np.add.at(sums, of, x)
            n = np.bincount(of, minlength=lists)
            self.centres[n > 0] = sums[n > 0] / n[n > 0, None]
        self.probes = self._measure(sample, x, k, recall)

    def rotated(self, vectors: np.ndarray, rows: bool) -> np.ndarray:
        """Vectors with their last component (rows; none for queries), rotated."""
        last = np.sqrt(np.maximum(self.norm ** 2 - (vectors ** 2).sum(axis=1), 0)) if rows else np.zeros(len(vectors))
        return np.column_stack([vectors, last]) @ self.rotation

    def _gaps(self, x: np.ndarray) -> np.ndarray:
        return (self.centres ** 2).sum(axis=1)[None, :] - 2 * (x @ self.centres.T)

    def nearest(self, x: np.ndarray) -> np.ndarray:
        parts = [self._gaps(x[i:i + CENTRE_ROWS]).argmin(axis=1) for i in range(0, len(x), CENTRE_ROWS)]
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)

    def ranked(self, queries: np.ndarray) -> np.ndarray:
        """Lists by distance from each query."""
        return np.argsort(self._gaps(self.rotated(queries, False)), axis=1, kind="stable")

    def _measure(self, sample: np.ndarray, x: np.ndarray, k: int, recall: float) -> int:
        q = sample[:SAMPLE_QUERIES]
        score = q @ sample.T
        score[np.arange(len(q)), np.arange(len(q))] = -np.inf
        k = min(k, len(sample) - 1)
        if k < 1:
            return len(self.centres)
        true = np.argpartition(-score, k - 1, axis=1)[:, :k]
        place = np.argsort(self.ranked(q), axis=1)  # of every list in the query's order
        needed = np.take_along_axis(place, self.nearest(x)[true], axis=1)
        held = [(needed < p).mean() for p in range(1, len(self.centres) + 1)]
        return 1 + next((p for p, h in enumerate(held) if h >= recall), len(self.centres) - 1)


class Chunk:
    """Vectors of a list, rotated, to be scanned by batches of queries."""

    def __init__(self, index: Index, ids: np.ndarray, vectors: np.ndarray):
        self.index, self.ids, self.vectors = index, ids, vectors
        self.x = index.rotated(vectors, True).astype(np.float32)
        n, d = self.x.shape
        self.cuts = [*range(0, d, COLUMNS), d]
        self.lengths = [(self.x[:, i:j] ** 2).sum(axis=1) for i, j in zip(self.cuts, self.cuts[1:], strict=False)]
        #: Component products done, and what all pairs in full would take.
        self.products, self.all_products = 0, 0

    def _bound(self, qs: np.ndarray, part: np.ndarray, alive: np.ndarray, k: int) -> np.ndarray:
        """Each query's k-th whole distance among the candidates nearest after the first block."""
        n = len(self.x)
        if np.count_nonzero(alive[0]) <= k or n <= k + 1:
            return np.full(len(qs), np.inf, np.float32)
        few = min(n, FIRST * k)
        near = np.argpartition(np.where(alive, part, np.inf), few - 1, axis=1)[:, :few]
        diff = self.x[near.ravel()].reshape(len(qs), few, -1) - qs[:, None, :]
        full = np.einsum("ijk,ijk->ij", diff, diff)
        self.products += full.size * self.x.shape[1]
        full = np.where(np.take_along_axis(alive, near, axis=1), full, np.inf)
        return np.partition(full, k - 1, axis=1)[:, k - 1]

    def scan(self, query_ids: np.ndarray, queries: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query's place, id, score) of each query's ``k`` best among the chunk, by the adaptive scan."""
        q = self.index.rotated(queries, False).astype(np.float32)
        n, d = self.x.shape
        out: list[tuple] = []
        step = max(1, (1 << 19) // max(1, n, FIRST * k * d // 8))
        for at in range(0, len(q), step):
            qs, own = q[at:at + step], query_ids[at:at + step]
            alive = self.ids[None, :] != own[:, None]
            self.all_products += alive.size * d
            # Blocks of columns for all pairs, while many live; then for the living pairs alone.
            part, pairs, bound = np.zeros(alive.shape, np.float32), None, None
            for block, (seen, upto) in enumerate(zip(self.cuts, self.cuts[1:], strict=False)):
                y = qs[:, seen:upto]
                if pairs is None:
                    part += (y ** 2).sum(axis=1)[:, None] + self.lengths[block][None, :]
                    part -= (2 * y) @ self.x[:, seen:upto].T
                    self.products += alive.size * (upto - seen)
                else:
                    for i in range(0, len(a), 1 << 17):
                        diff = y[a[i:i + (1 << 17)]] - self.x[b[i:i + (1 << 17)], seen:upto]
                        pairs[i:i + (1 << 17)] += np.einsum("ij,ij->i", diff, diff)
                    self.products += len(a) * (upto - seen)
                if bound is None:
                    bound = self._bound(qs, part, alive, k)
                scale = (1 + EPSILON / math.sqrt(upto)) ** 2 * upto / d if upto < d else 1.0
                limit = bound * scale * (1 + SLACK) + SLACK
                if pairs is None:
                    alive &= part <= limit[:, None]
                    if np.count_nonzero(alive) < SPARSE * alive.size or upto == d:
                        a, b = np.nonzero(alive)
                        pairs = part[a, b]
                else:
                    stay = pairs <= limit[a]
                    a, b, pairs = a[stay], b[stay], pairs[stay]
            score = np.empty(len(a))
            for i in range(0, len(a), 1 << 17):
                score[i:i + (1 << 17)] = np.einsum("ij,ij->i", queries[at + a[i:i + (1 << 17)]], self.vectors[b[i:i + (1 << 17)]])
            order = np.lexsort((self.ids[b], -score, a))
            a, b, score = a[order], b[order], score[order]
            best = np.arange(len(a)) - np.searchsorted(a, a) < k
            out.append((at + a[best], self.ids[b[best]], score[best]))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (
            np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0))


def scan(index: Index, ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray,
         k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's place, id, score) of each query's ``k`` best among ``vectors``, by the adaptive scan."""
    return Chunk(index, ids, vectors).scan(query_ids, queries, k)


def nearest_neighbours(df: DataFrame, is_query: Column | str, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K,
                       recall: float = RECALL, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` nearest found. ``is_query`` (or SQL) tests column ``id``."""
    is_query = F.expr(is_query) if isinstance(is_query, str) else is_query
    v = write_scratch(valid_vectors(df, id_col, vec_col), "scan-vectors")
    names = "query_id bigint, rank int, vec_id bigint, score double"
    facts = v.agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("vec", F.lit(0.0), lambda a, b: a + b * b)).alias("m"),
                  F.count(F.when(is_query, 1)).alias("q")).first()
    if not facts.n or not facts.q:
        return df.sparkSession.createDataFrame([], names)
    drawn = v.orderBy(F.xxhash64("id", "vec"), "id").limit(SAMPLE).select("vec").toPandas()["vec"]
    index = Index(np.array(drawn.tolist()), math.sqrt(facts.m), facts.n, k, recall)
    d = index.rotation.shape[0] - 1

    def assign(batches):
        import pyarrow as pa

        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(-1, d)
            if len(x):
                of = index.nearest(index.rotated(x, True))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(of.astype(np.int32)),
                     pa.array([r.tobytes() for r in x], pa.binary())], names=["id", "list", "vec"])

    rows = write_scratch(v.mapInArrow(assign, "id bigint, list int, vec binary")
                         .withColumn("row", F.monotonically_increasing_id()), "scan-lists")
    held = np.zeros(len(index.centres), np.int64)
    for r in rows.groupBy("list").count().collect():  # at most MAX_LISTS rows
        held[r["list"]] = r["count"]
    chunks = np.maximum(1, -(-held // chunk_rows))
    places = F.array(*[F.lit(int(c)) for c in chunks])

    # Rows go to their chunk once, queries to all chunks of their lists.
    candidates = rows.select("list", F.pmod(F.xxhash64("id", "vec"), F.element_at(places, F.col("list") + 1)).alias("chunk"),
                             F.lit(False).alias("asks"), "row", "id", "vec")

    def probe(batches):
        import pyarrow as pa

        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(2).to_pylist())).reshape(-1, d)
            if not len(x):
                continue
            order = index.ranked(x)
            enough = 1 + (np.cumsum(held[order], axis=1) <= k).sum(axis=1)  # lists that hold k others
            take = np.minimum(np.maximum(index.probes, enough), len(held))
            at, lists, chunk = [], [], []
            for i in range(len(x)):
                for number in order[i, :take[i]]:
                    if held[number]:
                        c = int(chunks[number])
                        at += [i] * c
                        lists += [number] * c
                        chunk += range(c)
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(lists, pa.int32()), pa.array(chunk, pa.int64()), pa.array(np.ones(len(at), bool)),
                 *(batch.column(c).take(at) for c in range(3))], names=["list", "chunk", "asks", "row", "id", "vec"])

    asks = map_arrow(rows.where(is_query).select("row", "id", "vec"), probe,
                     "list int, chunk bigint, asks boolean, row bigint, id bigint, vec binary")

    def search(batches):
        """A chunk's vectors come first, then the queries that ask it, in any number."""
        import pyarrow as pa

        key, ids, vecs, chunk = None, [], [], None
        for batch in batches:
            number, part, ask = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(3))
            edges = np.flatnonzero((number[1:] != number[:-1]) | (part[1:] != part[:-1]) | (ask[1:] != ask[:-1])) + 1
            row, own = (batch.column(c).to_numpy() for c in (3, 4))
            for i, j in zip([0, *edges], [*edges, len(number)], strict=True):
                if i == j:
                    continue
                if (number[i], part[i]) != key:
                    key, ids, vecs, chunk = (number[i], part[i]), [], [], None
                x = np.frombuffer(b"".join(batch.column(5).slice(i, j - i).to_pylist())).reshape(-1, d)
                if not ask[i]:
                    ids.append(own[i:j])
                    vecs.append(x)
                elif ids:
                    chunk = chunk or Chunk(index, np.concatenate(ids), np.concatenate(vecs))
                    at, found, score = chunk.scan(own[i:j], x, k)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(row[i:j][at]), pa.array(own[i:j][at]), pa.array(found), pa.array(score)],
                        names=["row", "query_id", "vec_id", "score"])

    order = ["list", "chunk", "asks"]
    together = candidates.unionByName(asks).repartition("list", "chunk").sortWithinPartitions(*order)
    found = map_arrow(together.select(*order, "row", "id", "vec"), search, "row bigint, query_id bigint, vec_id bigint, score double")
    by = Window.partitionBy("row").orderBy(F.col("score").desc(), "vec_id")
    return (found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
