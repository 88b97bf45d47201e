"""Exact top-k by inner product over a pivot-distance index.

Adding the component sqrt(M^2 - |x|^2) to each vector (0 to a query) turns the largest
inner product into the smallest distance: d^2 = |q|^2 + M^2 - 2 <q, x>. The index keys
every vector by its nearest pivot and its distance to it; rows are range-partitioned and
sorted by (pivot, distance, id), so a pivot that holds a third of all rows, or a vector
that very many rows share, is spread over as many partitions as it needs. A search expands
each pivot's annuli outwards from the query's own distance and stops where the triangle
inequality |d(q, p) - d(p, x)| exceeds the k-th best distance so far. Scores are integers
and exact; the bounds have a margin for rounding, so they never cut off a result or a tie.

Queries go in blocks of at most QUERY_BLOCK, which are broadcast one after another.

Defined results: vectors that are null, empty, of another length than the first one or
that hold null or non-finite components take no part, and neither do rows without an id.
Ties go to the smaller id; rows that repeat an id are candidates of their own, except for
queries with that id; a query id that repeats is one query (of its smallest vector).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, stage

PIVOTS = 64
QUERY_BLOCK = 8192
ANNULUS = 512  # rows that are scored at once
EXACT = 2.0**52


def quantised(vectors: DataFrame, id: str, vector: str, scale: int = 256) -> DataFrame:
    """(id, v): floor(scale * x) of each component as whole doubles."""
    x = F.col(vector)
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("double"))
    good = F.col(id).isNotNull() & x.isNotNull() & (F.size(x) > 0) & ~F.coalesce(bad, F.lit(False))
    return vectors.where(good).select(F.col(id).cast("long").alias("id"), whole.alias("v"))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _distances(x: np.ndarray, lift: np.ndarray, pivots: np.ndarray, pivot_lift: np.ndarray) -> np.ndarray:
    """Between lifted vectors and pivots (rows x pivots)."""
    square = (x**2).sum(1)[:, None] + (pivots**2).sum(1) - 2 * (x @ pivots.T) + (lift[:, None] - pivot_lift) ** 2
    return np.sqrt(np.maximum(square, 0))


class Index:
    """The staged index and what a search needs to know of it: pivots and the largest norm."""

    def __init__(self, vectors: DataFrame):
        size = vectors.agg(F.min_by(F.size("v"), F.struct("id", "v"))).first()[0]
        self.size = int(size or 0)
        rows = vectors.where(F.size("v") == self.size)
        norm = F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c)
        self.top = float(rows.agg(F.max(norm)).first()[0] or 0.0)
        picked = rows.select("v").distinct().orderBy(F.xxhash64("v"), "v").limit(PIVOTS).collect()
        self.pivots = np.array([r.v for r in picked], float).reshape(-1, max(self.size, 1))
        self.pivot_lift = self.lift(self.pivots)
        self.rows = stage(self._keyed(rows), "index")

    def lift(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.top - (x**2).sum(1), 0))

    def _keyed(self, rows: DataFrame) -> DataFrame:
        size, pivots, pivot_lift, lift = self.size, self.pivots, self.pivot_lift, self.lift
        top = self.top

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _matrix(batch.column("v"), size)
                distance = _distances(x, np.sqrt(np.maximum(top - (x**2).sum(1), 0)), pivots, pivot_lift)
                cell = distance.argmin(axis=1)
                near = distance[np.arange(len(x)), cell]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell.astype(np.int32)), pa.array(near), *batch.columns], names=["cell", "distance", "id", "v"]
                )

        keyed = rows.mapInArrow(run, "cell int, distance double, id long, v array<double>")
        keyed = keyed.repartitionByRange(partitions(rows.sparkSession), "cell", "distance", "id")
        return keyed.sortWithinPartitions("cell", "distance", "id")

    def search(self, ids: np.ndarray, queries: np.ndarray, k: int) -> DataFrame:
        """(query_id, id, score): at least the k best of every query, from each partition."""
        spark = self.rows.sparkSession
        near = _distances(queries, np.zeros(len(queries)), self.pivots, self.pivot_lift)
        norm, size, top = (queries**2).sum(1), self.size, self.top
        exact = bool(norm.max(initial=0) * self.top < EXACT**2)
        shared = spark.sparkContext.broadcast((ids, queries, near, norm))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own_ids, own, own_near, own_norm = shared.value
            best_score = np.full((len(own), k), -np.inf)
            best_id = np.full((len(own), k), np.iinfo(np.int64).max)
            margin = 1e-6 * (1 + np.sqrt(top) + np.sqrt(own_norm))

            def radius() -> np.ndarray:
                """The distance beyond which nothing can enter a query's k best."""
                return np.sqrt(np.maximum(own_norm + top - 2 * best_score[:, -1], 0)) + margin

            def expand(cell: int, distance: np.ndarray, row_ids: np.ndarray, x: np.ndarray) -> None:
                """Score the annuli of one cell that a query's radius still reaches, nearest first."""
                first = np.arange(0, len(x), ANNULUS)
                inner, outer = distance[first], distance[np.minimum(first + ANNULUS, len(x)) - 1]
                at = own_near[:, cell][:, None]
                bound = np.maximum(np.maximum(inner - at, at - outer), 0)  # queries x annuli
                for a in np.argsort(bound.min(axis=0), kind="stable"):
                    open_ = np.flatnonzero(bound[:, a] <= radius())
                    if not len(open_):
                        continue
                    part = slice(first[a], first[a] + ANNULUS)
                    if exact:
                        scores = own[open_] @ x[part].T
                    else:  # beyond 2^52 in Python's whole numbers
                        scores = (own[open_].astype(object) @ x[part].T.astype(object)).astype(float)
                    scores[own_ids[open_][:, None] == row_ids[part]] = -np.inf
                    better = (scores >= best_score[open_, -1][:, None]) & (scores > -np.inf)
                    for q in np.flatnonzero(better.any(axis=1)):
                        new = np.flatnonzero(better[q])
                        row = open_[q]
                        s = np.concatenate([best_score[row], scores[q, new]])
                        i = np.concatenate([best_id[row], row_ids[part][new]])
                        order = np.lexsort((i, -s))[:k]
                        best_score[row], best_id[row] = s[order], i[order]

            kept: list[tuple[np.ndarray, ...]] = []

            def flush() -> None:
                cell, distance, row_ids, x = (np.concatenate(c) for c in zip(*kept))
                kept.clear()
                for c in np.unique(cell):
                    mine = cell == c
                    expand(int(c), distance[mine], row_ids[mine], x[mine])

            held = 0
            for batch in batches:
                for lo in range(0, batch.num_rows, 4096):
                    part = batch.slice(lo, 4096)
                    kept.append((*(part.column(c).to_numpy() for c in ("cell", "distance", "id")), _matrix(part.column("v"), size)))
                    held += part.num_rows
                    if held >= 8192:
                        flush()
                        held = 0
            if kept:
                flush()
            q, r = np.nonzero(best_score > -np.inf)
            yield pa.RecordBatch.from_arrays(
                [pa.array(own_ids[q]), pa.array(best_id[q, r]), pa.array(best_score[q, r].astype(np.int64))], names=["query_id", "id", "score"]
            )

        return self.rows.mapInArrow(run, "query_id long, id long, score long")


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, id: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(query_id, rank, id, score): the ``k`` best rows of ``vectors`` for each of ``queries``."""
    spark = vectors.sparkSession
    index = Index(stage(quantised(vectors, id, vector, scale), "vectors"))
    asked = quantised(queries, id, vector, scale).where(F.size("v") == index.size)
    asked = stage(asked.groupBy("id").agg(F.min("v").alias("v")), "queries")
    blocks = -(-asked.count() // QUERY_BLOCK)
    parts = []
    for b in range(blocks):
        rows: pd.DataFrame = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).toPandas()
        if len(rows):
            found = index.search(rows["id"].to_numpy(), np.stack(rows["v"].to_numpy()), k)
            parts.append(stage(_ranked(found, k), "found"))
    if not parts:
        return spark.createDataFrame([], f"query_id long, rank int, {id} long, score long")
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out.select("query_id", "rank", F.col("id").alias(id), "score")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
