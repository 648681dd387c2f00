"""Principal axes of vectors, views on the first of them, and scaling that outliers do not stretch.

Means and second moments are sums over tasks: each task adds up its own rows' outer products, so the driver holds one
square matrix of the vectors' length (``MAX_DIM`` at most, checked) however many rows there are. Axes are ordered by
variance and turned so that their largest component is positive. Null vectors, and those with another length than
``dim`` or components that are not finite, are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.scalar import is_valid_vector
from ledgerloom.session import map_arrow

MAX_DIM = 2048


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def principal_axes(rows: DataFrame, vector: str, dim: int, k: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, axes, variances): the ``k`` axes of most variance as rows of a matrix; zeros without rows."""
    if dim > MAX_DIM:
        raise ValueError(f"vectors of {dim} components; at most {MAX_DIM}")
    good = rows.where(is_valid_vector(F.col(vector), dim)).select(F.col(vector).cast("array<double>").alias("v"))
    sums = good.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"), F.count("*").alias("n")).collect()  # dim rows
    n, mean = 0, np.zeros(dim)
    for r in sums:
        n, mean[r["i"]] = r["n"], r["x"] / r["n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            if batch.num_rows:
                own = _matrix(batch.column(0)) - mean
                total += own.T @ own
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim, dtype=np.int32)), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "row"])

    square = np.zeros((dim, dim))
    parts = map_arrow(good, run, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x"))
    for r in parts.collect():  # dim x dim
        square[r["i"], r["j"]] = r["x"]
    values, vectors = np.linalg.eigh(square / max(1, n - 1))
    axes = vectors[:, ::-1][:, :k].T
    axes = axes * np.where(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)] < 0, -1.0, 1.0)[:, None]
    return mean, axes, values[::-1][:k]


def projected(rows: DataFrame, vector: str, mean: np.ndarray, axes: np.ndarray) -> DataFrame:
    """``rows`` whose vectors are valid, with ``point``, their places on the axes."""
    rows = rows.where(is_valid_vector(F.col(vector), len(mean)))
    names, at = rows.columns, rows.columns.index(vector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = (_matrix(batch.column(at)) - mean) @ axes.T if batch.num_rows else np.empty((0, len(axes)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(points), pa.list_(pa.float64()))], names=[*names, "point"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return map_arrow(rows, run, f"{kinds}, point array<double>")


def robust_scaled(rows: DataFrame, point: str = "point", share: float = 0.99) -> DataFrame:
    """``rows`` with the points centred, divided by the ``share`` quantile of all distances from the centre on any axis
    (1 where it is 0), and clipped to [-1, 1]."""
    flat = rows.select(F.posexplode(point).alias("axis", "x"))
    centre = flat.groupBy("axis").agg(F.avg("x").alias("c"))  # a row for each axis
    away = flat.join(F.broadcast(centre), "axis").agg(F.percentile(F.abs(F.col("x") - F.col("c")), share).alias("s"))
    facts = centre.agg(F.transform(F.sort_array(F.collect_list(F.struct("axis", "c"))), lambda a: a["c"]).alias("_centre")).crossJoin(away)  # one row
    scale = F.when(F.col("s") > 0, F.col("s")).otherwise(1.0)
    unit = F.zip_with(point, "_centre", lambda x, c: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (x - c) / scale)))
    return rows.crossJoin(F.broadcast(facts)).withColumn(point, unit).drop("_centre", "s")
