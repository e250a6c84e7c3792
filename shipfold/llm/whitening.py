"""Whitening of embeddings with MLlib's BlockMatrix.

1. Valid vectors become whole numbers x = floor(scale * c) + shift. Sums per dimension
   and the count come from one aggregation, so the mean S / n is exact until rounded.
2. Rows are written with a dense index (a running count per written partition, one row
   each) and centred: the whole part is subtracted as integers, the fraction in double
   precision. An IndexedRowMatrix of them becomes a BlockMatrix.
3. The transposed BlockMatrix times itself gives the scatter. The long middle dimension is
   cut into ``splits`` parts, which partial products add up, so it is not one task's work.
4. The d x d covariance is decomposed on the driver (eigh). The BlockMatrix times the
   whitening matrix (eigenvectors over the roots of their eigenvalues) projects the rows.
5. The covariance of the projected rows, centred and multiplied the same way, is
   compared with the identity.

The driver holds d x d numbers and, inside MLlib's multiplication, one coordinate pair per
block of ``rows_per_block`` rows.

Defined cases: vectors null, empty, with null or non-finite entries, or of another length
than most take no part, nor do those with an entry of 2^40 or more (x would lose its last
digits in double precision); null ids and repeated rows are rows like any other; a
component whose eigenvalue is not above rounding (``FLAT`` of the largest) has a null
``whitened`` and counts for no ``identity_error``; with no variance at all ``explained`` is
null; a deviation past 64 bits is null; an empty table gives no rows. Other columns are
never read.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shipfold.llm.common import column, write_scratch

COMPONENTS = 32
SCALE, SHIFT = 64, 1_000_000
#: Rows of a block; its columns are the whole width, up to ``COLS_PER_BLOCK``.
ROWS_PER_BLOCK = 4096
COLS_PER_BLOCK = 1024
#: Blocks whose products one task adds up, about.
BLOCKS_PER_SPLIT = 16
#: Eigenvalues up to this share of the largest are rounding.
FLAT = 1e-11
LARGEST = float(1 << 40)


def whole_vectors(df: DataFrame, id_col: str, vec_col: str, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """(id, x array<bigint>) of the rows that take part."""
    v = df.select(column(df, id_col).alias("id"), column(df, vec_col).cast("array<double>").alias("vec"))
    fine = F.forall("vec", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST))
    v = v.where(F.coalesce(fine, F.lit(False)) & (F.size("vec") > 0))
    usual = v.groupBy(F.size("vec").alias("n")).count().orderBy(F.col("count").desc(), "n").first()
    v = v.where(F.size("vec") == (usual["n"] if usual else 0))
    return v.select("id", F.transform("vec", lambda c: F.floor(c * scale) + F.lit(shift).cast("bigint")).alias("x"))


def indexed(rows: DataFrame) -> DataFrame:
    """``rows`` written, with a dense ``index`` from 0."""
    written = write_scratch(rows.withColumn("at", F.monotonically_increasing_id()), "whitening-rows")
    written = written.withColumn("slice", F.shiftright("at", 33))
    starts = (written.groupBy("slice").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("size"))
              .withColumn("before", F.coalesce(F.sum("size").over(
                  Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    return (written.join(starts, "slice").withColumn("index", F.col("at") - F.col("first") + F.col("before"))
            .drop("slice", "at", "first", "size", "before"))


def sums_of(rows: DataFrame, values: str) -> tuple[int, list]:
    """(count, sum of each dimension) of an array column."""
    got = (rows.select(F.posexplode(values).alias("i", "v")).groupBy("i")
           .agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s")).orderBy("i").collect())
    return (got[0]["n"] if got else 0), [r["s"] for r in got]


def blocks_of(rows: DataFrame, values: str, rows_per_block: int, cols_per_block: int) -> BlockMatrix:
    """Rows (index, array<double>) in distributed blocks."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select("index", array_to_vector(values).alias("vector")), "vector")
    return IndexedRowMatrix(vectors).toBlockMatrix(rows_per_block, cols_per_block)


def scatter(matrix: BlockMatrix, rows: int, width: int) -> np.ndarray:
    """The transposed matrix times itself, on the driver: width x width."""
    splits = max(1, -(-rows // matrix.rowsPerBlock) // BLOCKS_PER_SPLIT)
    wide = matrix.transpose()
    # Python's multiply lacks the number of cuts of the middle dimension that Scala's takes.
    product = BlockMatrix(
        wide._java_matrix_wrapper.call("multiply", matrix._java_matrix_wrapper._java_model, splits),
        matrix.colsPerBlock, matrix.colsPerBlock)
    return np.asarray(product.toLocalMatrix().toArray()).reshape(width, width)


def project(matrix: BlockMatrix, weights: np.ndarray) -> DataFrame:
    """(index, whitened array<double>): the rows times the weights; all-zero rows may lack."""
    sc, step, width = matrix.blocks.context, matrix.colsPerBlock, weights.shape[1]
    parts = [((k // step, 0), Matrices.dense(len(w), width, w.flatten(order="F").tolist()))
             for k in range(0, len(weights), step) for w in [weights[k:k + step]]]
    product = matrix.multiply(BlockMatrix(sc.parallelize(parts, 1), step, width))
    rows = callMLlibFunc("getIndexedRows", product.toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    return rows.select("index", vector_to_array("vector").alias("whitened"))


def _whole(value: int):
    return F.lit(int(value)).cast("bigint")


def whiten(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS,
           scale: int = SCALE, shift: int = SHIFT, rows_per_block: int = ROWS_PER_BLOCK,
           cols_per_block: int = COLS_PER_BLOCK) -> DataFrame:
    """One row per valid row and component: id, component, n, deviation, whitened, explained, identity_error."""
    spark = df.sparkSession
    rows = indexed(whole_vectors(df, id_col, vec_col, scale, shift))
    n, sums = sums_of(rows, "x")
    if not n:
        kind = dict(df.dtypes)[id_col]
        return spark.createDataFrame([], f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, "
                                         "explained double, identity_error double")
    d, k = len(sums), min(components, len(sums))
    # x - S/n = (x - S div n) - (S mod n) / n, the first part exact in integers.
    whole, rest = (F.array(*[_whole(f(s, n)) for s in sums]) for f in (lambda s, n: s // n, lambda s, n: s % n))
    off = F.transform("x", lambda v, i: v - F.get(whole, i))
    exact = F.transform("off", lambda v, i: F.try_subtract(F.try_multiply(v, _whole(n)), F.get(rest, i)))
    squares = F.aggregate(exact, _whole(0), lambda a, v: F.try_add(a, F.try_multiply(v, v)))
    centred = F.transform("off", lambda v, i: v.cast("double") - F.get(rest, i).cast("double") / F.lit(float(n)))
    rows = write_scratch(rows.withColumn("off", off).select("id", "index", squares.alias("deviation"), centred.alias("centred")),
                         "whitening-centred")

    width = min(d, cols_per_block)
    matrix = blocks_of(rows, "centred", rows_per_block, width)
    values, vectors = np.linalg.eigh(scatter(matrix, n, d) / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    firm = values[:k] > FLAT * max(values[0], 0)
    weights = np.where(firm, vectors[:, :k] / np.sqrt(np.where(firm, values[:k], 1.0)), 0.0)
    zeros = F.array_repeat(F.lit(0.0), k)
    projected = write_scratch(
        rows.select("id", "index", "deviation").join(project(matrix, weights), "index", "left")
        .withColumn("whitened", F.coalesce("whitened", zeros)), "whitening-projected")

    # How far the projected rows' own covariance is from the identity.
    _, totals = sums_of(projected, "whitened")
    mean = F.array(*[F.lit(float(t / n)) for t in totals])
    again = projected.select("index", F.transform("whitened", lambda v, i: v - F.get(mean, i)).alias("centred"))
    gap = np.abs(scatter(blocks_of(again, "centred", rows_per_block, k), n, k) / n - np.eye(k))
    error = float(gap[np.ix_(firm, firm)].max()) if firm.any() else 0.0

    trace = float(values.sum())
    shares = F.array(*[F.lit(float(v / trace) if trace > 0 else None).cast("double") for v in np.maximum(values[:k], 0)])
    holds = F.array(*[F.lit(bool(f)) for f in firm])
    return (projected.select("id", "deviation", F.posexplode("whitened").alias("at", "value"))
            .select(F.col("id").alias(id_col), (F.col("at") + 1).alias("component"), _whole(n).alias("n"), "deviation",
                    F.when(F.get(holds, F.col("at")), F.col("value")).alias("whitened"),
                    F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error")))
