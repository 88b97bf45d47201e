"""Centroid clustering by Lloyd's rounds with Drake's adaptive bounds, exact in whole numbers.

Each vector keeps an upper bound on the distance to its centroid, lower bounds on those to its
next nearest few, in their order, and one remainder bound for all others. When centroids move,
bounds widen by how far each moved. The order is certified from the back: the first place from
which every bound exceeds the upper one ends what must be looked at. Within the few, only those
places are computed again and sorted; where the remainder bound itself does not exceed the upper
one, the vector is scanned against every centroid. After a round the number of bounds shrinks to the
last place that any vector needed, as long as that is an eighth of the centroids or more.

Components are whole numbers and distances are compared as exact squares, so ties go to the
smaller number; bounds are floating point with a margin, and certify only what is strictly
nearer. Sums are exact: centroids are floor(sum / count).

A round is one pass: each task writes its vectors with their bounds, and, in a folder apart, a row of
sums for each centroid, which Spark adds up before the driver reads one row a centroid and
component. Nothing is shuffled by cluster, so a cluster that holds most rows is no heavier.
The round before is deleted once the next is written.

Defined results: vectors that are null, of another length, or that hold null or non-finite
components take no part. Rows without an id are clustered too; their hash is of the text without a number.
Repeated rows and rows of one id are vectors of their own, also among the first centroids (ties of the
hash in the order of components). Fewer vectors than centroids give as many centroids as
vectors; an empty table gives no rows. Components beyond 2^22 are computed in Python's whole numbers; a component
beyond 2^63 counts as its end, and a distance or an inertia beyond it comes back as 2^63 - 1.
Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import outlive, stage, staging, unstage

SAFE = 1 << 22  # below it, squares of differences add up exactly in doubles
MARGIN = 1e-12
CHUNK = 4096  # rows of a full scan held at once
MOST = 2**63 - 1
STATE = "vec_id long, x array<long>, cluster int, upper double, near array<int>, lower array<double>, remainder double, distance decimal(38,0)"
SUMS = "count long, total array<decimal(38,0)>, inertia decimal(38,0), deepest int"
SCHEMA = f"{STATE}, {SUMS}, part string"


def whole(vectors: DataFrame, id: str, vector: str, size: int, scale: int = 1024) -> DataFrame:
    """(vec_id, x): floor(scale * c) of each component of the vectors that take part."""
    x = F.col(vector)
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    good = x.isNotNull() & (F.size(x) == size) & ~F.coalesce(bad, F.lit(False))
    return vectors.where(good).select(F.col(id).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("x"))


def starts(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors whose ids have the smallest hashes."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    picked = rows.select(hashed.alias("h"), "x").orderBy("h", "x").limit(k).collect()
    return np.array([r.x for r in picked], object)


@dataclass
class Move:
    """What a round needs to know: centroids, how far each came since the last round (None in the first), bounds to keep."""

    centroids: np.ndarray
    moved: np.ndarray | None
    bounds: int


def squares(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of ``x`` (n, d) to centroids (d) or to each row's own (n, z, d)."""
    if centroids.ndim == 3:
        return ((x[:, None, :] - centroids) ** 2).sum(axis=2)
    return ((x - centroids) ** 2).sum(axis=1)


def _root(square: np.ndarray) -> np.ndarray:
    return np.sqrt(square.astype(float))


class Bounds:
    """A batch of vectors with their state; ``settle`` gives them their nearest centroids."""

    def __init__(self, x: np.ndarray, move: Move):
        exact = max(np.abs(x.astype(float)).max(initial=0), np.abs(move.centroids.astype(float)).max(initial=0)) < SAFE
        kind = float if exact else object
        self.x, self.centroids, self.move = x.astype(kind), move.centroids.astype(kind), move
        n, k = len(x), len(move.centroids)
        self.b = min(move.bounds, k - 1)
        self.cluster = np.zeros(n, np.int32)
        self.upper = np.zeros(n)
        self.near = np.zeros((n, self.b), np.int32)
        self.lower = np.zeros((n, self.b))
        self.remainder = np.full(n, np.inf)
        self.scanned = self.deepest = 0

    def load(self, cluster, upper, near, lower, remainder) -> None:
        """State of the last round, widened by how far centroids moved; bounds no longer kept go into the remainder."""
        moved, b = self.move.moved, self.b
        self.cluster, self.near = cluster, near[:, :b]
        self.upper = upper + moved[cluster]
        lower = lower - moved[near]
        self.lower = lower[:, :b]
        self.remainder = np.minimum(remainder - moved.max(initial=0), lower[:, b:].min(axis=1, initial=np.inf))

    def scan(self, rows: np.ndarray) -> None:
        """All centroids, for the rows that bounds cannot settle."""
        self.scanned += len(rows)
        for at in range(0, len(rows), CHUNK):
            some = rows[at : at + CHUNK]
            square = np.stack([squares(self.x[some], c) for c in self.centroids], axis=1)
            order = np.argsort(square, axis=1, kind="stable")  # equal ones by number
            root = _root(np.take_along_axis(square, order, axis=1))
            self.cluster[some] = order[:, 0]
            self.upper[some] = root[:, 0] * (1 + MARGIN)
            self.near[some] = order[:, 1 : self.b + 1]
            self.lower[some] = root[:, 1 : self.b + 1] * (1 - MARGIN)
            self.remainder[some] = root[:, self.b + 1] * (1 - MARGIN) if root.shape[1] > self.b + 1 else np.inf

    def _places(self, rows: np.ndarray) -> np.ndarray:
        """How many of the next nearest each row must look at; b + 1 where even the remainder is in doubt."""
        if not len(rows):
            return np.zeros(0, int)
        bounds = np.concatenate([self.lower[rows], self.remainder[rows, None]], axis=1)
        least = np.minimum.accumulate(bounds[:, ::-1], axis=1)[:, ::-1]
        clear = least > self.upper[rows, None]
        return np.where(clear.any(axis=1), clear.argmax(axis=1), bounds.shape[1])

    def settle(self) -> None:
        rows = np.arange(len(self.x))
        rows = rows[self._places(rows) > 0]
        own = squares(self.x[rows], self.centroids[self.cluster[rows]][:, None, :])[:, 0] if len(rows) else np.zeros(0)
        self.upper[rows] = _root(own) * (1 + MARGIN)
        places = self._places(rows)
        self.scan(rows[places > self.b])
        for z in range(1, self.b + 1):
            some = rows[places == z]
            if not len(some):
                continue
            self.deepest = max(self.deepest, z)
            which = np.concatenate([self.cluster[some, None], self.near[some, :z]], axis=1)
            square = squares(self.x[some], self.centroids[which])
            order = np.lexsort((which, square.astype(float) if square.dtype != object else _ranks(square)), axis=1)
            which, root = np.take_along_axis(which, order, axis=1), _root(np.take_along_axis(square, order, axis=1))
            self.cluster[some], self.upper[some] = which[:, 0], root[:, 0] * (1 + MARGIN)
            self.near[some, :z], self.lower[some, :z] = which[:, 1:], root[:, 1:] * (1 - MARGIN)

    def sums(self) -> list[tuple]:
        """(cluster, count, totals, inertia) of the centroids that have rows here."""
        square = squares(self.x, self.centroids[self.cluster])
        self.square = square if square.dtype != object else np.minimum(square, MOST)
        out = []
        for c in np.unique(self.cluster):
            mine = self.cluster == c
            kind = object if self.x.dtype == object else np.int64
            total, inertia = self.x[mine].astype(kind).sum(axis=0), self.square[mine].astype(kind).sum()
            out.append((int(c), int(mine.sum()), [int(t) for t in total], int(inertia)))
        return out


def _ranks(square: np.ndarray) -> np.ndarray:
    """Ranks of whole numbers beyond doubles, equal ones alike."""
    return np.unique(square, return_inverse=True)[1].reshape(square.shape)


def _rows(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _pass(rows: DataFrame, move: Move, width: int) -> DataFrame:
    """One round: the vectors with their new state (part rows) and sums of each task (part sums)."""
    fresh = "cluster" not in rows.columns
    kinds = [("vec_id", pa.int64()), ("x", pa.list_(pa.int64())), ("cluster", pa.int32()), ("upper", pa.float64()), ("near", pa.list_(pa.int32())),
             ("lower", pa.list_(pa.float64())), ("remainder", pa.float64()), ("distance", pa.decimal128(38)), ("count", pa.int64()),
             ("total", pa.list_(pa.decimal128(38))), ("inertia", pa.decimal128(38)), ("deepest", pa.int32()), ("part", pa.string())]
    schema = pa.schema(kinds)

    def batch_of(columns: dict, n: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)) for f in schema], schema=schema)

    def lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
        flat = pa.array(np.ascontiguousarray(values).ravel(), kind)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1], pa.int32()), flat)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        deepest, scanned = 0, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            state = Bounds(_rows(batch.column("x"), width), move)
            if fresh:
                state.scan(np.arange(n))
            else:
                kept = len(batch.column("near")[0])
                state.load(
                    batch.column("cluster").to_numpy().copy(), batch.column("upper").to_numpy(), _rows(batch.column("near"), kept).copy(),
                    _rows(batch.column("lower"), kept), batch.column("remainder").to_numpy(),
                )
                state.settle()
                deepest, scanned = max(deepest, state.deepest), scanned + state.scanned
            for c, count, total, inertia in state.sums():
                old = held.get(c)
                held[c] = [count, total, inertia] if old is None else [old[0] + count, [a + b for a, b in zip(old[1], total)], old[2] + inertia]
            yield batch_of({
                "vec_id": batch.column("vec_id"), "x": batch.column("x").cast(pa.list_(pa.int64())), "cluster": pa.array(state.cluster, pa.int32()),
                "upper": pa.array(state.upper), "near": lists(state.near, pa.int32()), "lower": lists(state.lower, pa.float64()),
                "remainder": pa.array(state.remainder), "distance": pa.array([Decimal(int(s)) for s in state.square], pa.decimal128(38)),
                "part": pa.array(["rows"] * n),
            }, n)
        if held:
            reach = state.b if scanned else deepest  # where a scan was needed no bound is idle
            yield batch_of({
                "cluster": pa.array(list(held), pa.int32()), "count": pa.array([h[0] for h in held.values()]),
                "total": pa.array([[Decimal(t) for t in h[1]] for h in held.values()], pa.list_(pa.decimal128(38))),
                "inertia": pa.array([Decimal(h[2]) for h in held.values()], pa.decimal128(38)), "deepest": pa.array([reach] * len(held), pa.int32()),
                "part": pa.array(["sums"] * len(held)),
            }, len(held))

    return rows.mapInArrow(run, SCHEMA)


def _read_sums(done: DataFrame, k: int, width: int) -> tuple[np.ndarray, np.ndarray, list[int], int]:
    """Counts, totals and inertia of each centroid and the last place needed: a row a centroid and component on the driver."""
    sums = done.where("part = 'sums'").select("cluster", "count", "inertia", "deepest", F.posexplode("total").alias("i", "t"))
    added = sums.groupBy("cluster", "i").agg(
        F.sum("t").alias("t"), F.sum("count").alias("n"), F.sum("inertia").alias("inertia"), F.max("deepest").alias("deepest")
    )
    counts, totals, inertia, deepest = np.zeros(k, object), np.zeros((k, width), object), [0] * k, 0
    for r in added.collect():
        totals[r.cluster, r.i], counts[r.cluster], inertia[r.cluster] = int(r.t), r.n, int(r.inertia)
        deepest = max(deepest, r.deepest)
    return counts, totals, inertia, deepest


@dataclass
class Clusters:
    """The last round: (vec_id, cluster, distance, ...) as a staged table, centroids, and squared distances summed over each."""

    rows: DataFrame
    centroids: np.ndarray
    inertia: list[int]
    bounds: list[int]  # kept in each round


def cluster(
    vectors: DataFrame, k: int = 8, rounds: int = 10, id: str = "vec_id", vector: str = "embedding", size: int = 64, scale: int = 1024, seed: int = 3,
    bounds: int | None = None,
) -> Clusters | None:
    """Clusters of the vectors of ``size`` components after ``rounds`` rounds and a last assignment; None without vectors.

    ``bounds`` lower bounds are kept at first: a quarter of the centroids, two at least, unless it is given.
    """
    with staging(vectors.sparkSession):
        rows = stage(whole(vectors, id, vector, size, scale), "vectors")
        centroids = starts(rows, k, seed)
        if not len(centroids):
            return None
        k = len(centroids)
        kept = max(2, -(-k // 4)) if bounds is None else bounds
        move, inertia, used = Move(centroids, None, min(kept, k - 1)), [0] * k, []
        for _ in range(rounds + 1):
            done = stage(_pass(rows, move, size), "round", by="part")
            unstage(rows)
            counts, totals, inertia, deepest = _read_sums(done, k, size)
            rows = done.where("part = 'rows'").select("vec_id", "x", "cluster", "upper", "near", "lower", "remainder", "distance")
            if len(used) == rounds:
                break
            used.append(move.bounds)
            after = np.array([[int(t) // int(n) for t in total] if n else list(c) for total, n, c in zip(totals, counts, move.centroids)], object)
            moved = _root(np.array([sum((int(p) - int(q)) ** 2 for p, q in zip(a, b)) for a, b in zip(after, move.centroids)], object)) * (1 + MARGIN)
            still = bool((after == move.centroids).all())
            if still:  # the same centroids give the same clusters in every later round
                break
            fewer = move.bounds if move.moved is None else min(move.bounds, max(1, k // 8, deepest))
            move = Move(after, moved, min(fewer, k - 1))
        return Clusters(outlive(rows), move.centroids, inertia, used)


def report(found: Clusters | None, spark, id: str = "vec_id") -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each vector."""
    schema = "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    if found is None:
        return spark.createDataFrame([], f"{id} long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    capped = lambda n: min(int(n), MOST)
    digest = [hashlib.sha256(",".join(str(int(c)) for c in row).encode()).hexdigest() for row in found.centroids]
    told = [(c, capped(found.inertia[c]), capped(sum(found.inertia)), digest[c]) for c in range(len(digest))]
    told = spark.createDataFrame(told, schema)  # a row a centroid
    distance = F.least("distance", F.lit(MOST).cast("decimal(38,0)")).cast("long")
    rows = found.rows.select(F.col("vec_id").alias(id), "cluster", distance.alias("distance"))
    return rows.join(F.broadcast(told), "cluster").select(id, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
