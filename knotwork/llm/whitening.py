"""Whitening of embeddings: singular values of the centred rows, found by Spark MLlib.

Entries become integers x = floor(64 c) + 1000000. The fit list holds each distinct
integer vector once; its sums are added exactly. ``computeSVD`` runs on the centred
rows of that list, spread over the cluster; a singular value s is the eigenvalue
s * s / n of the covariance with divisor n. All of them are asked for, because MLlib
then decomposes the Gram matrix in full and not by an iteration with a tolerance. The
total variance comes from the exact deviations, not from the singular values. One more
pass over the fit list measures how far the whitened covariance is from the identity.

Each vector's deviation is exact at any size (decimal); products are made in 64-bit
integers where they fit and in Python's integers where they don't.

Defined cases: vectors that are null, empty or hold null or non-finite entries take no
part, nor do those of another length than the most frequent one (of equally frequent
ones the shortest) or with an entry of LARGEST or more, whose integers have no exact
double; a null id stays null; repeated ids and rows are rows each, and one vector of the
fit list where equal; components whose eigenvalue is lost in rounding (as when all
vectors are equal) are left out, so there may be fewer than asked for and none for an
empty table; of a component's two signs the one with its largest entry positive is
taken; other columns are ignored.

What the driver holds grows with the vectors' length only: the Gram matrix and, from
each task, sums of that length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.llm.common import arrow_map, written

SCALE, SHIFT = 64, 1_000_000
LARGEST = float(1 << 46)


@dataclass
class Whitening:
    """What a fit found: ``components`` has a column for each of them, ``sums`` are exact."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray
    identity_error: float


def integers(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, x (array of long) of the vectors that take part."""
    v = F.col("v")
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")).where(v.isNotNull() & (F.size(v) > 0))
    good = rows.where(F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST)))
    dims = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).first()
    same = good.where(F.size("v") == (dims.d if dims else 0))
    return same.select("vec_id", F.transform("v", lambda c: F.floor(c * SCALE).cast("long") + SHIFT).alias("x"))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of an array column as a matrix; all are of one length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def offsets(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exactly: as 64-bit integers where they fit, else as Python's."""
    largest = max(int(np.abs(x).max(initial=0)) * n, max(abs(s) for s in sums))
    kind = np.int64 if largest < 1 << 61 else object
    return x.astype(kind) * n - np.array(sums, kind)


def squares(d: np.ndarray) -> np.ndarray:
    """Sum of squares of each row, exactly."""
    most = int(np.abs(d).max(initial=0))
    if most * most * d.shape[1] >= 1 << 62:
        d = d.astype(object)
    return (d * d).sum(axis=1)


def fit_sums(fit: DataFrame) -> tuple[int, list[int]]:
    """Rows of the fit list and their sum in each dimension."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(0))
                here = x.sum(axis=0) if int(np.abs(x).max()) * len(x) < 1 << 62 else x.astype(object).sum(axis=0)
                n, total = n + len(x), here.astype(object) if total is None else total + here
        if n:
            yield pa.record_batch([pa.array(range(len(total)), pa.int32()), pa.array([n] * len(total)), pa.array([str(t) for t in total])], names=["k", "n", "total"])

    parts = arrow_map(fit.select("x"), add, "k int, n long, total string")
    rows = parts.groupBy("k").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).orderBy("k").collect()  # one row a dimension
    return (rows[0].n, [int(r.total) for r in rows]) if rows else (0, [])


def singular(fit: DataFrame, n: int, sums: list[int], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(components as columns, eigenvalues) of the fit list's covariance, by MLlib, up to ``k``."""
    dims = len(sums)

    def centre(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                y = (offsets(matrix(batch.column(0)), n, sums) / n).astype(np.float64)
                yield pa.record_batch([pa.ListArray.from_arrays(np.arange(0, y.size + 1, dims, dtype=np.int32), y.ravel())], names=["y"])

    rows = written(arrow_map(fit.select("x"), centre, "y array<double>"), "centred")
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector("y").alias("y")), "y")
    found = RowMatrix(vectors, n, dims).computeSVD(dims)
    s, v = found.s.toArray(), found.V.toArray()
    e = s * s / n
    clear = np.flatnonzero(e > e[:1].max(initial=0.0) * dims * 2.0**-44)[:k] if len(e) else np.empty(0, int)
    v, e = v[:, clear], e[clear]
    if v.size:
        v = v * np.sign(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])])
    return v, e


def projected(x: np.ndarray, n: int, sums: list[int], components: np.ndarray, eigenvalues: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whitened coordinates, exact deviations) of integer vectors."""
    d = offsets(x, n, sums)
    return (d / n).astype(np.float64) @ components / np.sqrt(eigenvalues), squares(d)


def checked(fit: DataFrame, n: int, sums: list[int], components: np.ndarray, eigenvalues: np.ndarray) -> tuple[int, float]:
    """(sum of the fit list's deviations, largest entry of the whitened covariance minus the identity)."""
    k = len(eigenvalues)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sums_w, products = 0, np.zeros(k), np.zeros((k, k))
        for batch in batches:
            if batch.num_rows:
                w, dev = projected(matrix(batch.column(0)), n, sums, components, eigenvalues)
                total, sums_w, products = total + sum(dev.tolist()), sums_w + w.sum(axis=0), products + w.T @ w
        values = [*sums_w.tolist(), *products.ravel().tolist(), 0.0]
        yield pa.record_batch([pa.array(range(len(values)), pa.int32()), pa.array(values), pa.array(["0"] * (len(values) - 1) + [str(total)])], names=["at", "value", "total"])

    parts = arrow_map(fit.select("x"), add, "at int, value double, total string")
    rows = parts.groupBy("at").agg(F.sum("value").alias("value"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).orderBy("at").collect()  # k * (k + 1) + 1 rows
    value = np.array([r.value for r in rows])
    mean, products = value[:k] / n, value[k:-1].reshape(k, k) / n
    return int(rows[-1].total), float(np.abs(products - np.outer(mean, mean) - np.eye(k)).max(initial=0.0))


def fit_whitening(rows: DataFrame, k: int = 16) -> Whitening | None:
    """Fit on the distinct vectors of (x); None where there is no component."""
    fit = written(rows.select("x").distinct(), "fit")
    n, sums = fit_sums(fit)
    if not n:
        return None
    components, eigenvalues = singular(fit, n, sums, k)
    if not len(eigenvalues):
        return None
    deviations, error = checked(fit, n, sums, components, eigenvalues)
    trace = deviations / n**3
    return Whitening(n, sums, components, eigenvalues, eigenvalues / trace, error)


def transform(rows: DataFrame, found: Whitening | None) -> DataFrame:
    """vec_id, n, deviation (decimal), whitened and explained (arrays, by component), identity_error of (vec_id, x)."""
    schema = "vec_id long, deviation string, whitened array<double>"

    def whiten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and found is not None:
                w, dev = projected(matrix(batch.column(1)), found.n, found.sums, found.components, found.eigenvalues)
                lists = pa.ListArray.from_arrays(np.arange(0, w.size + 1, w.shape[1], dtype=np.int32), w.ravel())
                yield pa.record_batch([batch.column(0), pa.array([str(d) for d in dev.tolist()]), lists], names=["vec_id", "deviation", "whitened"])

    told = [] if found is None else found.explained.tolist()
    return arrow_map(rows.select("vec_id", "x"), whiten, schema).select(
        "vec_id", F.lit(found.n if found else 0).cast("long").alias("n"), F.col("deviation").cast("decimal(38,0)").alias("deviation"), "whitened",
        F.array(*[F.lit(e) for e in told]).cast("array<double>").alias("explained"), F.lit(found.identity_error if found else 0.0).alias("identity_error"))


def whiten(df: DataFrame, k: int = 16, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Fit on a table's vectors and whiten all of them."""
    rows = integers(df, id_col, vec_col)
    return transform(rows, fit_whitening(rows, k))
