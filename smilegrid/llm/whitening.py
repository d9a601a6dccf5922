"""Embedding whitening with distributed block matrices.

Rows are numbered, centred exactly and cut into blocks of a BlockMatrix. Its
transpose times itself is the scatter matrix; the small scatter is decomposed on
the driver; a second block product with the whitening matrix projects all rows.
The covariance of what came out is a third product, so the reported identity
error is measured on the result and not derived.

The driver holds the sums and matrices of dimension x dimension only (MAX_DIMS bounds
them). Row blocks are spread over tasks in every product: the inner dimension is
split, so that no task takes all blocks for the one scatter block. The driver also
lists the blocks' coordinates, a pair of numbers per BLOCK_ENTRIES entries.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import load, numbered

#: Entries of a block, and blocks that one task of a product takes.
BLOCK_ENTRIES, BLOCKS_A_TASK = 1 << 16, 16
#: The scatter matrix of so many dimensions is 128 MB on the driver; longer vectors are an error.
MAX_DIMS = 4096
#: Entries are held on a grid of 1 / SCALE, shifted by OFFSET; beyond +-LARGEST grid steps they are set to that.
SCALE, OFFSET, LARGEST = 64, 1_000_000, 1 << 36
COMPONENTS = 32


@dataclass(frozen=True)
class Whitened:
    """What `whiten` returns: a row per vector, and the model that made it."""

    rows: DataFrame  # key columns, n, deviation, whitened (array of double, one per component)
    values: np.ndarray  # eigenvalues by falling size
    vectors: np.ndarray  # eigenvectors, one column each
    trace: float
    identity_error: float


def on_grid(vector: Column) -> Column:
    """The entries as long: floor(SCALE * entry) + OFFSET."""
    step = lambda c: F.least(F.greatest(F.floor(c.cast("double") * F.lit(float(SCALE))), F.lit(-LARGEST)), F.lit(LARGEST))
    return F.transform(vector, lambda c: step(c).cast("long") + F.lit(OFFSET).cast("long"))


def usable(vector: Column) -> Column:
    """Not null, and every entry a finite number."""
    fine = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return F.coalesce(F.forall(vector, lambda c: F.coalesce(fine(c.cast("double")), F.lit(False))), F.lit(False))


def _block_matrix(rows: DataFrame, index: str, vector: str, n: int, dims: int) -> BlockMatrix:
    plain = rows.select(F.col(index).cast("long").alias("index"), array_to_vector(F.col(vector)).alias("vector"))
    old = MLUtils.convertVectorColumnsFromML(plain, "vector")
    return IndexedRowMatrix(old, n, dims).toBlockMatrix(max(1, BLOCK_ENTRIES // dims), dims)


def _product(left: BlockMatrix, right: BlockMatrix, splits: int = 1) -> BlockMatrix:
    """left x right, with the inner dimension cut into so many splits, each a task of its own per result block."""
    made = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(made, left.rowsPerBlock, right.colsPerBlock)


def scatter(matrix: BlockMatrix) -> np.ndarray:
    """The transpose of `matrix` times itself."""
    splits = max(1, -(-matrix.numRowBlocks // BLOCKS_A_TASK))
    return _product(matrix.transpose(), matrix, splits).toLocalMatrix().toArray()


def whiten(vectors: DataFrame, vector: str, keys: list[str], components: int = COMPONENTS) -> Whitened | None:
    """Centre, rotate and scale all usable rows of `vectors`; None if there is none.

    A row counts if its vector has no null or non-finite entry, has at least one entry
    and is as long as the longest such vector (a shorter one lacks entries, and is left out like
    one with nulls). Repeated rows and rows with null keys are rows like all others; other
    columns are not read. Eigenvectors have their largest entry positive.

    A component whose eigenvalue is not above rounding (identical rows, constant or dependent
    dimensions, fewer rows than dimensions) is 0 for every row, and is left out of the identity error.
    `deviation` is null where it exceeds a long.
    """
    spark = vectors.sparkSession
    rows = vectors.where(usable(F.col(vector)) & (F.size(vector) > 0)).select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keys)], on_grid(F.col(vector)).alias("x"))
    rows = numbered(rows, "index")
    dims = rows.agg(F.max(F.size("x"))).first()[0]
    if dims is None:
        return None
    if dims > MAX_DIMS:
        raise ValueError(f"vectors of {dims} entries; at most {MAX_DIMS} are supported")
    if rows.where(F.size("x") < dims).limit(1).count():
        rows = numbered(rows.where(F.size("x") == dims).drop("index"), "index")
    sums = rows.select(F.posexplode("x").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("sum"), F.count(F.lit(1)).alias("n")).orderBy("at").collect()
    n, total = sums[0]["n"], F.array(*[F.lit(r["sum"]) for r in sums])
    away = F.zip_with("x", total, lambda x, s: F.try_subtract(F.try_multiply(x, F.lit(n)), s))
    square = F.aggregate("away", F.lit(0).cast("long"), lambda a, d: F.try_add(a, F.try_multiply(d, d)))
    # Exact before it is divided; only where that exceeds a long it is a difference of doubles.
    centred = F.zip_with("x", total, lambda x, s: F.coalesce(F.try_subtract(F.try_multiply(x, F.lit(n)), s).cast("double") / float(n), x - s / float(n)))
    rows = rows.withColumn("away", away)

    matrix = _block_matrix(rows.select("index", centred.alias("v")), "index", "v", n, dims)
    cov = scatter(matrix) / n
    values, turned = np.linalg.eigh((cov + cov.T) / 2)
    values, turned = values[::-1], turned[:, ::-1]
    turned = turned * np.sign(turned[np.abs(turned).argmax(axis=0), np.arange(dims)])
    k = min(components, dims)
    rounding = max(values[0], 0.0) * dims * np.finfo(float).eps * 16
    live = values[:k] > rounding
    scale = np.where(live, 1 / np.sqrt(np.where(live, values[:k], 1.0)), 0.0)
    weights = turned[:, :k] * scale
    one = spark.sparkContext.parallelize([((0, 0), Matrices.dense(dims, k, weights.ravel(order="F").tolist()))], 1)
    projected = _product(matrix, BlockMatrix(one, dims, k, dims, k))
    error = scatter(projected) / n - np.diag(live.astype(float))
    error = float(np.abs(error[np.ix_(live, live)]).max()) if live.any() else 0.0

    made = callMLlibFunc("getIndexedRows", projected.toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    made = made.select(F.col("index"), vector_to_array("vector").alias("whitened"))
    named = rows.select("index", *[F.col(f"k{i}").alias(c) for i, c in enumerate(keys)], F.lit(n).cast("long").alias("n"), square.alias("deviation"))
    return Whitened(named.join(made, "index").drop("index"), values, turned, float(np.trace(cov)), error)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whiten(load(spark, sf_dir, "embeddings"), "embedding", ["vec_id"])
    if found is None:
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    shares = [float(v / found.trace) if found.trace > 0 else 0.0 for v in found.values[:COMPONENTS]]
    out = found.rows.select("vec_id", "n", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return out.select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        "n",
        "deviation",
        "whitened",
        F.get(F.array(*[F.lit(s) for s in shares]), F.col("at")).alias("explained"),
        F.lit(found.identity_error).alias("identity_error"),
    )
