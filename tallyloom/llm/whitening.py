"""Whitening of embeddings: exact centring, MLlib's RowMatrix, a local eigh and a broadcast projection.

Entries become whole numbers x. The fit list is each distinct vector once; its sums S are exact, so
n*x - S is an exact whole number and (n*x - S) / n is the centred row, rounded once. RowMatrix adds up
the Gramian of these rows in the JVM; divided by n it is the covariance, whose eigenvectors are taken on
the driver (dimension squared numbers, whatever the rows). Tasks then project each row of the
table, with n*x - S as long as it is exact in a long and in Python's whole numbers beyond.
The whitened fit list's own covariance, by RowMatrix again, gives the error against the identity.

Defined results: vectors that are null, empty, or that hold null or non-finite entries are
dropped; so are those of another length than the most frequent one (ties to the longer), since one covariance
has one dimension. Entries beyond 2^61 count as 2^61. Repeated rows, rows of one id and rows without an id all come back;
copies count once in the fit. A component without variance (its eigenvalue is nought but for rounding: one
vector only, fewer vectors than dimensions, entries all equal) has null in ``whitened``, and is left out of the error against the identity;
``explained`` and ``identity_error`` are null if no component varies. A deviation beyond a long is null. An
empty table gives no rows. Columns other than the id and the vector are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, staging

LIMIT = 1 << 61
FLAT = 1e-11  # an eigenvalue under this part of the largest is rounding


def whole(vectors: DataFrame, id: str, vector: str, scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """(id, x): floor(scale * c) + shift of each entry of the vectors that take part."""
    x = F.col(vector)
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    good = x.isNotNull() & (F.size(x) > 0) & ~F.coalesce(bad, F.lit(False))
    near = lambda c: F.greatest(F.lit(float(-LIMIT)), F.least(F.lit(float(LIMIT)), c.cast("double") * scale))
    return vectors.where(good).select(F.col(id).alias("id"), F.transform(x, lambda c: F.floor(near(c)).cast("long") + shift).alias("x"))


@dataclass
class Whitening:
    """What the fit list gives: its size and sums, eigenvalues and -vectors of its covariance, and its trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n*x - S: longs where they and their squares add up within one, or else whole numbers of Python."""
        most = int(np.abs(x.astype(float)).max(initial=0) * 1.0001) + 1
        away = self.n * most + max(map(abs, self.sums))
        if away < 1 << 62:
            out = self.n * x.astype(np.int64) - np.array(self.sums, np.int64)
            if int(np.abs(out).max(initial=0)) ** 2 * x.shape[1] < 1 << 62:
                return out
            return out.astype(object)
        return self.n * x.astype(object) - np.array(self.sums, object)

    def project(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(deviation, whitened) of the rows; whitened is not a number for components without variance."""
        away = self.deviations(x)
        square = (away**2).sum(axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            scaled = np.where(self.values > 0, 1 / np.sqrt(self.values), np.nan)
        return square, (away.astype(float) / self.n) @ self.vectors * scaled


def _matrix(rows: DataFrame, column: str, n: int, size: int) -> np.ndarray:
    """RowMatrix's Gramian of an array column of doubles."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(column).alias("v")), "v")
    return RowMatrix(vectors, n, size).computeGramianMatrix().toArray()


def _longs(sums: DataFrame) -> list[int]:
    return [int(v) for v in sums.first()]


def fit(distinct: DataFrame, size: int, components: int) -> Whitening | None:
    """The whitening of ``distinct`` (x), a staged table of distinct vectors of ``size`` entries."""
    n = distinct.count()
    if not n:
        return None
    entries = [F.sum(F.col("x")[i].cast("decimal(20,0)")) for i in range(size)]
    sums = _longs(distinct.agg(*entries))
    totals = F.array(*(F.lit(str(s)).cast("decimal(38,0)") for s in sums))
    near = max(map(abs, sums)) < 1 << 60 and n < 1 << 20  # n*x - S in longs, for entries that the next line checks
    small = near and (distinct.agg(F.max(F.expr("array_max(transform(x, c -> abs(c)))"))).first()[0] or 0) < 1 << 40
    if small:
        totals = F.array(*(F.lit(s).cast("long") for s in sums))
        away = F.transform(F.arrays_zip(F.col("x"), totals.alias("s")), lambda e: (e["x"] * F.lit(n) - e["s"]).cast("double") / F.lit(float(n)))
    else:
        step = lambda e: (e["x"].cast("decimal(20,0)") * F.lit(n).cast("decimal(17,0)") - e["s"]).cast("double") / F.lit(float(n))
        away = F.transform(F.arrays_zip(F.col("x"), totals.alias("s")), step)
    gramian = _matrix(distinct.select(away.alias("row")), "row", n, size)
    covariance = gramian / n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(values)[::-1][:components]
    top = values[order].copy()
    top[top <= FLAT * max(float(values.max()), 0.0)] = 0.0
    return Whitening(n, sums, top, vectors[:, order], float(np.trace(covariance)))


def identity_error(distinct: DataFrame, found: Whitening) -> float | None:
    """The largest entry of the whitened fit list's covariance minus the identity."""
    live = int((found.values > 0).sum())
    if not live:
        return None
    shared = distinct.sparkSession.sparkContext.broadcast(found)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"w": list(shared.value.project(np.stack(batch["x"].to_numpy()))[1][:, :live])})

    with staging(distinct.sparkSession):
        whitened = stage(distinct.mapInPandas(run, "w array<double>"), "whitened")
        means = np.array(whitened.agg(*(F.avg(F.col("w")[i]) for i in range(live))).first(), float)
        centred = whitened.select(F.array(*(F.col("w")[i] - F.lit(float(m)) for i, m in enumerate(means))).alias("w"))
        return float(np.abs(_matrix(centred, "w", found.n, live) / found.n - np.eye(live)).max())


def whiten(
    vectors: DataFrame, components: int = 16, id: str = "vec_id", vector: str = "embedding", scale: int = 64, shift: int = 1_000_000
) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of each remaining row and component up to ``components``."""
    spark = vectors.sparkSession
    kind = dict(vectors.dtypes)[id]
    schema = f"{id} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = whole(vectors, id, vector, scale, shift)
    sizes = rows.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    if sizes is None:
        return spark.createDataFrame([], schema)
    size = sizes["size"]
    rows = rows.where(F.size("x") == size)
    with staging(spark):
        distinct = stage(rows.select("x").distinct(), "fit")
        found = fit(distinct, size, components)
        error = identity_error(distinct, found)
    shared = spark.sparkContext.broadcast(found)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = shared.value
        k = len(found.values)
        explained = found.values / found.trace if found.trace > 0 else np.full(k, np.nan)
        for batch in batches:
            if not len(batch):
                continue
            square, whitened = found.project(np.stack(batch["x"].to_numpy()))
            deviation = pd.array([int(s) if s < 1 << 63 else None for s in square], "Int64")
            yield pd.DataFrame({
                id: batch["id"].repeat(k).reset_index(drop=True), "component": np.tile(np.arange(1, k + 1, dtype=np.int32), len(batch)), "n": np.int64(found.n),
                "deviation": deviation.repeat(k), "whitened": whitened.ravel(), "explained": np.tile(explained, len(batch)),
                "identity_error": np.nan if error is None else error,
            })

    out = rows.mapInPandas(run, schema)
    plain = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    return out.select(id, "component", "n", "deviation", plain("whitened"), plain("explained"), plain("identity_error"))
