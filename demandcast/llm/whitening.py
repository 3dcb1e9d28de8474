"""Embedding whitening with Spark MLlib's BlockMatrix.

Vectors are indexed, centred and laid out as a distributed matrix of dense blocks (one
block column, some thousand rows a block). The matrix times its transpose is the scatter;
its eigenvectors are found on the driver, which holds one ``dimensions x dimensions``
matrix and no row. The block matrix times the whitening matrix (eigenvectors over the
roots of their eigenvalues) projects every row, and the same product over the projected
rows tells how far their covariance is from the identity.

Entries are made whole numbers first (``floor(64 c) + 1000000``), so sums are exact and a
centred entry ``(n x - S) / n`` is rounded once; nothing is multiplied before it is
centred.

What grows: blocks are spread over the tasks; in the scatter they are dealt by row block
into ``splits`` products that are summed, so no task sees all rows. The driver gets the
block coordinates (one pair per block of rows), n and the sums per dimension.

Defined cases: rows whose vector is null, holds a null, NaN or infinite entry, or is
shorter than the longest remaining vector (its last entries are missing) are dropped, as
are empty vectors; repeated rows and repeated or null ids count and return a row each;
components without variance (eigenvalue within rounding of 0) have no whitened value and
are left out, so equal vectors, a single row or an empty table give no row; extra columns
are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandcast.session import ensure_checkpoint_dir, shared_path

#: A vector entry c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: Entries of a block (of 8 bytes each), and row blocks that one scatter product sums.
BLOCK_ENTRIES, BLOCKS_A_SPLIT = 1 << 18, 8


@dataclass
class Whitening:
    """Sums and eigenvectors of a fit list of ``n`` rows."""

    n: int
    sums: list[int]
    values: np.ndarray       # eigenvalues, falling
    vectors: np.ndarray      # dimensions x components, columns of length 1
    trace: float

    @property
    def matrix(self) -> np.ndarray:
        return self.vectors / np.sqrt(self.values)


def whole_vectors(rows: DataFrame) -> DataFrame:
    """``vec_id, x``: the remaining rows, entries as whole numbers."""
    ok = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c.cast("double"))
                  & (F.abs(c.cast("double")) < float("inf")))
    kept = rows.filter(ok & (F.size("embedding") > 0)).select("vec_id", F.transform(
        "embedding", lambda c: F.floor(c.cast("double") * SCALE).cast("long") + SHIFT).alias("x"))
    longest = kept.agg(F.max(F.size("x"))).first()[0]
    return kept.filter(F.size("x") == F.lit(longest))


def indexed(rows: DataFrame, folder: str) -> DataFrame:
    """``index, vec_id, x`` with gapless indexes from 0, written below ``folder``.

    A row's index is its place in its task plus the rows of the tasks before it, so no
    sort moves the rows; the written table fixes both.
    """
    spark = rows.sparkSession
    rows.withColumn("__at", F.monotonically_increasing_id()).write.parquet(f"{folder}/rows")
    stored = spark.read.parquet(f"{folder}/rows")
    task, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    sizes = sorted(stored.groupBy(task.alias("task")).count().collect())  # a number per task
    before, firsts = 0, []
    for r in sizes:
        firsts.append((r["task"], before))
        before += r["count"]
    first = spark.createDataFrame(firsts, "task long, first long")
    return (stored.withColumn("task", task).join(F.broadcast(first), "task")
            .select((F.col("first") + place).alias("index"), "vec_id", "x"))


def dimension_sums(rows: DataFrame) -> tuple[int, list[int]]:
    """Row count and exact sum per dimension: one number per dimension leaves a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1)
                n, total = n + len(x), x.sum(axis=0) + (0 if total is None else total)
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(-1, len(total)), pa.int32()), pa.array(np.array([n, *total]), pa.int64())],
                names=["dimension", "total"])

    sums = (rows.select("x").mapInArrow(run, "dimension int, total long")
            .groupBy("dimension").agg(F.sum("total").alias("total")).orderBy("dimension").collect())
    return (sums[0].total, [r.total for r in sums[1:]]) if sums else (0, [])


def block_matrix(rows: DataFrame, n: int, width: int) -> BlockMatrix:
    """``index long, v array<double>`` as dense blocks, one block column wide."""
    vectors = rows.select("index", array_to_vector("v").alias("vector"))
    matrix = IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "vector"), n, width)
    return matrix.toBlockMatrix(block_rows(width), width)


def block_rows(width: int) -> int:
    return max(1, BLOCK_ENTRIES // width)


def scatter(blocks: BlockMatrix) -> np.ndarray:
    """The transposed matrix times the matrix, ``width x width``.

    The product is one block; without splits its one task would gather all row blocks.
    """
    splits = max(1, -(-blocks.numRowBlocks // BLOCKS_A_SPLIT))
    # BlockMatrix.multiply(other, numMidDimSplits) is public; Python's wrapper lacks the number
    product = blocks.transpose()._java_matrix_wrapper.call(
        "multiply", blocks._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, blocks.colsPerBlock, blocks.colsPerBlock).toLocalMatrix().toArray()


def centred(n: int, sums: list[int]):
    """``x - S/n`` of an array column x, exact but for one rounding."""
    s = F.array(*[F.lit(v).cast("long") for v in sums])
    return F.zip_with("x", s, lambda x, t: (x * n - t).cast("double") / float(n))


def fit_whitening(rows: DataFrame, components: int = COMPONENTS) -> tuple[Whitening | None, BlockMatrix | None]:
    """The whitening of indexed rows, and their centred block matrix."""
    n, sums = dimension_sums(rows)
    if n == 0:
        return None, None
    blocks = block_matrix(rows.select("index", centred(n, sums).alias("v")), n, len(sums))
    covariance = scatter(blocks) / n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1]
    some = values > max(values[0], 0) * len(sums) * np.finfo(float).eps * 16
    some[components:] = False
    if not some.any():
        return None, None
    vectors = vectors[:, some]
    # either sign will do: the largest entry is positive, so reruns agree
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), range(vectors.shape[1])])
    return Whitening(n, sums, values[some], vectors, float(np.trace(covariance))), blocks


def project(spark: SparkSession, blocks: BlockMatrix, matrix: np.ndarray) -> DataFrame:
    """``index, v``: every row of the block matrix times ``matrix``."""
    width, k = matrix.shape
    block = ((0, 0), Matrices.dense(width, k, matrix.ravel("F").tolist()))
    right = BlockMatrix(spark.sparkContext.parallelize([block], 1), width, k)
    rows = blocks.multiply(right).toIndexedRowMatrix()
    out = callMLlibFunc("getIndexedRows", rows._java_matrix_wrapper._java_model)
    return out.select("index", vector_to_array("vector").alias("v"))


def identity_error(projected: DataFrame, n: int, k: int) -> float:
    """Largest absolute entry of the projected rows' covariance minus the identity."""
    means = projected.select([F.avg(F.col("v")[i]).alias(f"m{i}") for i in range(k)]).first()
    middle = F.array(*[F.lit(float(m)) for m in means])
    moved = projected.select("index", F.zip_with("v", middle, lambda v, m: v - m).alias("v"))
    return float(np.abs(scatter(block_matrix(moved, n, k)) / n - np.eye(k)).max())


def whiten(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``: a row per
    remaining vector and component."""
    spark = rows.sparkSession
    ensure_checkpoint_dir(spark)
    folder = shared_path(spark, f"whitening/{uuid.uuid4().hex}")
    table = indexed(whole_vectors(rows), folder)
    fit, blocks = fit_whitening(table, components)
    id_type = rows.schema["vec_id"].dataType.simpleString()
    if fit is None:
        return spark.createDataFrame([], f"vec_id {id_type}, component int, n long, deviation long, "
                                         "whitened double, explained double, identity_error double")
    project(spark, blocks, fit.matrix).write.parquet(f"{folder}/projected")
    projected = spark.read.parquet(f"{folder}/projected")
    k = len(fit.values)
    error = identity_error(projected, fit.n, k)
    sums = F.array(*[F.lit(v).cast("long") for v in fit.sums])
    squares = F.zip_with("x", sums, lambda x, s: ((x * fit.n - s).cast("decimal(19,0)")
                                                  * (x * fit.n - s).cast("decimal(19,0)")).cast("decimal(38,0)"))
    deviation = F.aggregate(squares, F.lit(0).cast("decimal(38,0)"), lambda a, v: (a + v).cast("decimal(38,0)"))
    explained = F.array(*[F.lit(float(v / fit.trace)) for v in fit.values])
    return (table.select("index", "vec_id", deviation.cast("long").alias("deviation"))
            .join(projected, "index")
            .select("vec_id", "deviation", F.posexplode("v").alias("at", "whitened"))
            .select("vec_id", (F.col("at") + 1).alias("component"), F.lit(fit.n).cast("long").alias("n"),
                    "deviation", "whitened", explained[F.col("at")].alias("explained"),
                    F.lit(error).alias("identity_error")))
