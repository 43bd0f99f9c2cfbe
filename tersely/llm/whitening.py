"""Whitening of embeddings with distributed block matrices (MLlib's BlockMatrix).

Vectors become integers, the distinct ones are the fit list. Their mean is taken off each
row before anything is multiplied, as (n * x - S) / n with exact integers in the bracket, so
that a large common offset costs no digits. The centred rows are indexed and cut into
blocks; blocks' transpose times blocks, summed over splits of the long side, is the
scatter, a matrix of one row and column for each dimension. It comes to the driver, numpy
decomposes it, and the whitening matrix goes back as a BlockMatrix of its own: blocks of
all rows times that matrix are the whitened rows. How far their covariance is from the
identity is measured on the whitened fit list in the same way.

The driver holds squares of the dimension and the numbers of the blocks.

* Vectors that are null or hold a null or non-finite entry take no part; shorter ones, also
  empty ones, count as filled up with entries of 0. Repeated ids and vectors each give their rows; equal
  vectors count once in the fit.
* Components whose eigenvalue is nothing but rounding error (relative to the largest, as in
  numpy's matrix_rank) are left out, as no scale could give them unit variance: with one
  distinct vector, or none, there is no row. Equal eigenvalues keep the order numpy gives them.
* ``scale`` times an entry must be below 2**62 in size; else the job ends with an error that names
  the row's id.
* Columns other than the two named are not looked at and do not come back.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tersely.llm.common import placed, written

ROWS, COLUMNS = 4096, 1024  # of a block
LARGEST = 2.0**62
SCHEMA = (
    "vec_id long, component int, n long, deviation decimal(38,0), whitened double, "
    "explained double, identity_error double"
)


def integers(vectors: DataFrame, scale: float, offset: int, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and x, floor(scale * c) + offset for each entry, of the vectors that take part."""
    entry = F.transform(vector_col, lambda c: c.cast("double"))
    rows = vectors.select(F.col(id_col).alias("vec_id"), entry.alias("c"))
    sound = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    rows = rows.where(F.col("c").isNotNull() & F.forall("c", sound))
    name = F.concat(F.lit("entry too large for a 64-bit integer in row "), F.col("vec_id").cast("string"))
    whole = lambda c: F.when(
        F.abs(c * scale) < LARGEST, F.floor(c * scale) + F.lit(offset).cast("long")
    ).otherwise(F.raise_error(F.coalesce(name, F.lit("entry too large"))).cast("long"))
    return rows.select("vec_id", F.transform("c", whole).alias("x"))


def times(left: BlockMatrix, right: BlockMatrix, splits: int) -> BlockMatrix:
    """The product, its inner dimension dealt over ``splits`` tasks for each result block."""
    product = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, left.rowsPerBlock, right.colsPerBlock)


def blocks(rows: DataFrame, numbers: Column, count: int, dims: int) -> BlockMatrix:
    """The arrays ``numbers`` of ``rows``, indexed by ``at``, as a matrix in blocks."""
    vectors = rows.select(F.col("at").alias("index"), array_to_vector(numbers).alias("vector"))
    indexed = IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "vector"), count, dims)
    return indexed.toBlockMatrix(ROWS, COLUMNS)


def crossed(matrix: BlockMatrix, splits: int) -> np.ndarray:
    """Transpose times matrix, on the driver: one row and column for each column."""
    return times(matrix.transpose(), matrix, splits).toLocalMatrix().toArray()


def projection(whiten: np.ndarray, like: DataFrame) -> BlockMatrix:
    parts = [
        ((at // COLUMNS, 0), Matrices.dense(len(part), part.shape[1], part.ravel(order="F").tolist()))
        for at in range(0, len(whiten), COLUMNS)
        for part in [whiten[at : at + COLUMNS]]
    ]
    context = like.sparkSession.sparkContext
    return BlockMatrix(context.parallelize(parts, len(parts)), COLUMNS, COLUMNS, *whiten.shape)


def whitened(
    vectors: DataFrame,
    components: int = 16,
    scale: float = 64.0,
    offset: int = 1_000_000,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """One row for each vector that takes part and each of the first ``components``.

    vec_id, component (from 1), n (fit list), deviation (sum of (n * x - S)^2, exact), whitened,
    explained (share of the variance) and identity_error (largest entry of the whitened
    covariance less the identity).
    """
    spark = vectors.sparkSession
    rows = integers(vectors, scale, offset, id_col, vector_col)
    dims = rows.agg(F.max(F.size("x"))).first()[0] or 0
    rest = F.array_repeat(F.lit(offset).cast("long"), F.lit(dims) - F.size("x"))
    rows = rows.withColumn("x", F.concat("x", rest))
    fit = placed(rows.select("x").distinct(), [], ["x"], "whitening-fit")
    entries = fit.select(F.posexplode("x").alias("dim", "value"))
    sums = entries.groupBy("dim").agg(
        F.sum(F.col("value").cast("decimal(19,0)")).cast("string").alias("s"), F.count("*").alias("n")
    )
    sums = sorted(sums.collect())  # one row for each dimension
    if not sums:
        return spark.createDataFrame([], SCHEMA)
    n = sums[0].n
    count = F.lit(n).cast("decimal(19,0)")
    total = F.array(*[F.lit(row.s).cast("decimal(38,0)") for row in sums])
    off = F.zip_with("x", total, lambda x, s: (x.cast("decimal(19,0)") * count - s).cast("decimal(38,0)"))
    centred = F.transform("off", lambda d: d.cast("double") / n)
    square = lambda d: (d * d).cast("decimal(38,0)")
    deviation = F.aggregate(
        "off", F.lit(0).cast("decimal(38,0)"), lambda a, d: (a + square(d)).cast("decimal(38,0)")
    )
    splits = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // ROWS)))

    fit_blocks = blocks(fit.withColumn("off", off), centred, n, dims)
    values, axes = np.linalg.eigh(crossed(fit_blocks, splits) / n)
    values, axes = values[::-1], axes[:, ::-1]
    real = values > max(values[0], 0) * dims * np.finfo(float).eps
    used = np.flatnonzero(real)[:components]
    if not len(used):
        return spark.createDataFrame([], SCHEMA)
    whiten = projection(axes[:, used] / np.sqrt(values[used]), vectors)
    spread = crossed(times(fit_blocks, whiten, 1), splits) / n
    error = float(np.abs(spread - np.eye(len(used))).max())

    at = placed(rows, [], ["vec_id", "x"], "whitening-rows").withColumn("off", off)
    every = at.agg(F.count("*")).first()[0]
    turned = times(blocks(at, centred, every, dims), whiten, 1).toIndexedRowMatrix()
    projected = callMLlibFunc("getIndexedRows", turned._java_matrix_wrapper._java_model)
    projected = written(
        projected.select(F.col("index").alias("at"), vector_to_array("vector").alias("w")), "whitening-rows"
    )
    share = F.array(*[F.lit(float(v)) for v in values[used] / values.sum()])
    wide = at.select("at", "vec_id", deviation.alias("deviation")).join(projected, "at")
    long = wide.select("vec_id", "deviation", F.posexplode("w").alias("c", "whitened"))
    return long.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        (F.col("c") + 1).alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.element_at(share, F.col("c") + 1).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
