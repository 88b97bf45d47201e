"""Similarity joins by Indel ratio over an index of character counts.

An Indel distance is at least the difference of two texts' character counts, summed over all characters
(a metric, so the triangle inequality holds). The index keeps distinct keys by their nearest pivot and
their distance to it, in blocks of keys at like distances. A text asks a block only if the bound that
pivots, distances and lengths give it reaches the text's floor: a cutoff, or, for the k best, the
k-th best score of a few likely keys of its first blocks. Asked blocks meet their texts by an equi-join
on the block: rows are sorted so that a task holds one block while its texts stream by, and a block
that very many texts ask is dealt to several tasks. In a block, the bound of each pair's own counts comes
next, and a bit-parallel LCS over all pairs that are left.

What is broadcast is bounded: PIVOTS pivots, and a line on each of about BLOCKS blocks, which
grow with the keys instead of becoming more.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import sort_tokens
from ..staging import outlive, stage, staging

KINDS = 128  # characters are counted by this many kinds; kinds that fall together only loosen the bound
PIVOTS = 512
SAMPLE = 8192  # keys that pivots are chosen from
LEAST_BLOCK, BLOCKS = 512, 1 << 16
FIRST = 1536  # keys that a text's first blocks hold
SHARE = 4096  # texts of a block in one task
CELLS = 1 << 22  # numbers held at once
NEAR = 1 << 17  # and those of a step that a processor's cache should hold
_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)
_NONE = np.uint32(0xFFFFFFFF)


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` over all cores: by their few bytes, adaptive execution would put costly rows into one task."""
    return rows.repartition(_tasks(rows))


def _tasks(rows: DataFrame) -> int:
    spark = rows.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def counts(texts: list[str]) -> np.ndarray:
    """How often each kind of character is in each text."""
    points = [_points(t) for t in texts]
    every = np.concatenate([*points, np.zeros(0, np.uint32)]).astype(np.int64)
    row = np.repeat(np.arange(len(texts)), [len(p) for p in points])
    kind = (every + 8 * (every >> 8)) % KINDS  # Latin letters, digits and Arabic letters mostly apart
    return np.bincount(row * KINDS + kind, minlength=len(texts) * KINDS).reshape(-1, KINDS).astype(np.int32)


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Summed differences of counts, rows of ``a`` by rows of ``b``: no Indel distance is smaller."""
    out = np.empty((len(a), len(b)), np.int32)
    kind = np.int16 if max(a.max(initial=0), b.max(initial=0)) < 128 else np.int32
    seen = b.any(axis=0)
    alone = a[:, ~seen].sum(axis=1, dtype=np.int32)
    a, b = a[:, seen].astype(kind), b[:, seen].astype(kind)
    step = max(1, NEAR // max(1, b.size))
    for at in range(0, len(a), step):
        out[at : at + step] = np.abs(a[at : at + step, None, :] - b).sum(axis=2, dtype=kind if kind == np.int16 else np.int64)
    return out + alone[:, None]


def _share(distance: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The ratio of texts of ``total`` characters at an Indel distance."""
    return np.where(total == 0, 100.0, 100.0 - 100.0 * distance / np.maximum(total, 1))


class Keys:
    """Keys of a block: bounds and exact ratios of pairs of a text and a key."""

    def __init__(self, keys: list[str]):
        self.keys, self.lengths = keys, np.array([len(k) for k in keys], np.int64)
        self.counts = counts(keys)
        self.words = np.maximum(1, -(-self.lengths // 64))
        self._masks: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def _of(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bit masks of the keys of up to ``size`` words: (characters, masks by character, word and key, place of each key)."""
        if size not in self._masks:
            rows = np.flatnonzero((self.words <= size) & (self.words > size // 2))
            points = [_points(self.keys[r]) for r in rows]
            known, at = np.unique(np.concatenate([*points, np.zeros(0, np.uint32)]), return_inverse=True)
            masks = np.zeros((len(known) + 1, size, len(rows)), np.uint64)  # the last for characters that no key has
            place = np.concatenate([np.arange(len(p)) for p in points])
            row = np.repeat(np.arange(len(rows)), [len(p) for p in points])
            np.bitwise_or.at(masks, (at, place // 64, row), np.uint64(1) << (place % 64).astype(np.uint64))
            where = np.zeros(len(self.keys), np.int64)
            where[rows] = np.arange(len(rows))
            self._masks[size] = known, masks, where
        return self._masks[size]

    def common(self, texts: list[str], i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """LCS lengths of the pairs of text ``i`` and key ``j``, those of like lengths at once."""
        out = np.zeros(len(i), np.int64)
        lengths = np.array([len(t) for t in texts], np.int64)
        sizes = 1 << np.ceil(np.log2(self.words)).astype(np.int64)
        shape = sizes[j] << 32 | 1 << np.ceil(np.log2(np.maximum(lengths[i], 8))).astype(np.int64)
        for s in np.unique(shape):
            pairs = np.flatnonzero(shape == s)
            size, width = int(s >> 32), int(s & 0xFFFFFFFF)
            step = max(1, CELLS // (size * 8 + width))
            for at in range(0, len(pairs), step):
                some = pairs[at : at + step]
                out[some] = self._lcs(texts, i[some], j[some], size, width)
        return out

    def _lcs(self, texts: list[str], i: np.ndarray, j: np.ndarray, size: int, width: int) -> np.ndarray:
        known, masks, where = self._of(size)
        used, row = np.unique(i, return_inverse=True)
        points = np.full((len(used), width), _NONE)
        for r, t in enumerate(used):
            points[r, : len(texts[t])] = _points(texts[t])
        at = np.searchsorted(known, points)
        code = np.where(known[np.minimum(at, len(known) - 1)] == points, at, len(known)) if len(known) else np.zeros_like(at)
        key = where[j]
        v = np.full((size, len(i)), _ONES)
        for p in range(max(len(texts[t]) for t in used)):
            c = code[row, p]
            carry = np.zeros(len(i), np.uint64)
            for w in range(size):
                m = masks[c, w, key]
                u = v[w] & m
                total = v[w] + u
                if size > 1:
                    over = total < u
                    total = total + carry
                    carry = (over | (total < carry)).astype(np.uint64)
                v[w] = total | (v[w] & ~m)
        return np.bitwise_count(~v).sum(axis=0, dtype=np.int64)

    def ratios(self, texts: list[str], i: np.ndarray, j: np.ndarray) -> np.ndarray:
        total = np.array([len(t) for t in texts], np.int64)[i] + self.lengths[j]
        return np.where(total == 0, 100.0, 200.0 * self.common(texts, i, j) / np.maximum(total, 1))

    def reaching(self, texts: list[str], floors: np.ndarray, k: int | None, order: np.ndarray, probe: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(text, key, ratio) of the pairs at their text's floor or over it, the ``k`` best of a text if given
        (ties by ``order``), and how many pairs were scored. Best bounds come first, and raise the floor; a
        ``probe`` ends with these."""
        lengths = np.array([len(t) for t in texts], np.int64)
        bound = _share(apart(counts(texts), self.counts), lengths[:, None] + self.lengths)
        floors, n = floors.astype(float).copy(), len(texts)
        found = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        scored, step = 0, len(self.keys) if k is None else 4 * k
        while True:
            open_ = bound >= floors[:, None] - 1e-9
            if not open_.any():
                break
            if step < bound.shape[1] and open_.sum(axis=1).max() > step:  # the best open ones of each text
                at = np.argpartition(np.where(open_, -bound, np.inf), step - 1, axis=1)[:, :step]
                i, j = np.repeat(np.arange(n), step), at.ravel()
                keep = open_[i, j]
                i, j = i[keep], j[keep]
            else:
                i, j = np.nonzero(open_)
            bound[i, j] = -np.inf
            ratio = self.ratios(texts, i, j)
            scored += len(i)
            fit = ratio >= floors[i]
            found = [np.concatenate([a, b[fit]]) for a, b in zip(found, (i, j, ratio))]
            if k is not None:
                i, j, ratio = found
                rank = np.lexsort((order[j], -ratio, i))
                first = np.searchsorted(i[rank], np.arange(n + 1))
                place = np.arange(len(rank)) - first[i[rank]]
                found = [x[rank][place < k] for x in found]
                last = place == k - 1
                floors[i[rank][last]] = np.maximum(floors[i[rank][last]], ratio[rank][last])
            if probe:
                break
            step = min(4 * step, bound.shape[1])
        return *found, scored


@dataclass
class Index:
    """Distinct keys in blocks: ``blocks`` is staged (block, keys, firsts), the rest is small."""

    blocks: DataFrame
    pivots: np.ndarray  # counts of the pivots
    block: np.ndarray
    cell: np.ndarray
    inner: np.ndarray
    outer: np.ndarray
    shortest: np.ndarray
    longest: np.ndarray
    rows: np.ndarray

    def bounds(self, texts: list[str]) -> np.ndarray:
        """What the ratio of each text to the keys of each block cannot exceed."""
        lengths = np.array([len(t) for t in texts], np.int64)[:, None]
        to = apart(counts(texts), self.pivots)
        at = to[:, self.cell]
        least = np.maximum(np.maximum(self.inner - at, at - self.outer), (at - to.min(axis=1, keepdims=True) + 1) // 2)
        least = np.maximum(np.maximum(least, np.maximum(self.shortest - lengths, lengths - self.longest)), 0)
        return _share(least, lengths + self.longest)


def _pivots(texts: list[str], most: int) -> np.ndarray:
    """Texts far from one another: each next one is the farthest from those before."""
    every = counts(texts)
    picked = every[:1]
    near = apart(every, picked)[:, 0]
    while len(picked) < most and near.max(initial=0) > 0:
        picked = np.concatenate([picked, every[[near.argmax()]]])
        near = np.minimum(near, apart(every, picked[-1:])[:, 0])
    return picked


def build(keys: DataFrame) -> Index | None:
    """The index of ``keys`` (key, first: a number that ties go by), distinct by key. Staged; None without keys."""
    spark = keys.sparkSession
    n = keys.count()
    if not n:
        return None
    size = max(LEAST_BLOCK, -(-n // BLOCKS))
    sample = [r.key for r in keys.select("key").orderBy(F.xxhash64("key"), "key").limit(SAMPLE).collect()]
    pivots = _pivots(sample, min(PIVOTS, max(1, 2 * n // LEAST_BLOCK)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                to = apart(counts(batch.column("key").to_pylist()), pivots)
                cell = to.argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(cell.astype(np.int32)), pa.array(to[np.arange(len(to)), cell])], names=[*batch.schema.names, "cell", "distance"]
                )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Consecutive keys of a cell as one row, up to ``size`` of them."""
        number = TaskContext.get().partitionId() << 32
        held: list[tuple] = []

        def row() -> pa.RecordBatch:
            nonlocal number
            names, firsts, cells, distances = zip(*held)
            lengths = [len(x) for x in names]
            number += 1
            out = [[number], [cells[0]], [distances[0]], [distances[-1]], [min(lengths)], [max(lengths)], [list(names)], [list(firsts)]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds)], names=["block", "cell", "inner", "outer", "shortest", "longest", "keys", "firsts"])

        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int64())]
        for batch in batches:
            for one in zip(*(batch.column(c).to_pylist() for c in ("key", "first", "cell", "distance"))):
                if held and (held[-1][2] != one[2] or len(held) >= size):
                    yield row()
                    held.clear()
                held.append(one)
        if held:
            yield row()

    placed = spread(keys.select("key", "first")).mapInArrow(place, "key string, first long, cell int, distance int")
    ordered = placed.repartitionByRange(_tasks(keys), "cell", "distance", "key").sortWithinPartitions("cell", "distance", "key")
    blocks = stage(ordered.mapInArrow(cut, "block long, cell int, inner int, outer int, shortest int, longest int, keys array<string>, firsts array<long>"), "blocks")
    told = blocks.select("block", "cell", "inner", "outer", "shortest", "longest", F.size("keys").alias("n")).toPandas()
    return Index(blocks.select("block", "keys", "firsts"), pivots, *(told[c].to_numpy() for c in told.columns))


def _visits(texts: DataFrame, index: Index, first: int | None = None) -> DataFrame:
    """(text, block, floor) of the blocks that each of ``texts`` (text, floor) asks: those whose bound
    reaches the floor, or, with ``first``, those of the best bounds until they hold so many keys."""
    shared = texts.sparkSession.sparkContext.broadcast(
        Index(None, index.pivots, index.block, index.cell, index.inner, index.outer, index.shortest, index.longest, index.rows)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        step = max(1, CELLS // (8 * len(index.block)))
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                names, floors = part.column("text"), part.column("floor").to_numpy()
                bound = index.bounds(names.to_pylist())
                ask = bound >= floors[:, None] - 1e-9
                if first is not None:
                    order = np.argsort(-bound, axis=1, kind="stable")
                    before = np.cumsum(index.rows[order], axis=1) - index.rows[order] < first
                    np.put_along_axis(ask, order, before, axis=1)
                i, b = np.nonzero(ask)
                if len(i):
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(i)), pa.array(index.block[b]), pa.array(floors[i])], names=["text", "block", "floor"])

    return texts.mapInArrow(run, "text string, block long, floor double")


def _asked(visits: DataFrame, index: Index, k: int | None, probe: bool = False) -> DataFrame:
    """(text, key, first, score) of staged ``visits``: in each block the keys at the floor, the ``k`` best if
    given; of a ``probe`` only likely ones."""
    dealt = visits.groupBy("block").agg(F.ceil(F.count("*") / SHARE).cast("int").alias("parts"))
    none = lambda kind: F.lit(None).cast(kind)
    held = index.blocks.join(dealt, "block").select("block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "keys", "firsts")
    held = held.select("block", "part", F.lit(0).alias("kind"), none("string").alias("text"), none("double").alias("floor"), "keys", "firsts")
    texts = visits.join(dealt, "block").withColumn("part", F.pmod(F.xxhash64("text"), F.col("parts")).cast("int"))
    texts = texts.select("block", "part", F.lit(1).alias("kind"), "text", "floor", none("array<string>").alias("keys"), none("array<long>").alias("firsts"))
    both = held.union(texts).repartition(8 * _tasks(visits), "block", "part").sortWithinPartitions("block", "part", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = firsts = names = None
        for batch in batches:
            kind = batch.column("kind").to_numpy()
            heads = np.flatnonzero(kind == 0)
            for lo, hi in zip([0, *(heads + 1)], [*heads, len(kind)]):
                step = max(64, CELLS // (16 * len(keys.keys))) if keys else 1
                for at in range(lo, hi, step):
                    part = batch.slice(at, min(hi, at + step) - at)
                    i, j, score, _ = keys.reaching(part.column("text").to_pylist(), part.column("floor").to_numpy(), k, firsts, probe)
                    if len(i):
                        yield pa.RecordBatch.from_arrays(
                            [part.column("text").take(pa.array(i)), names.take(pa.array(j)), pa.array(firsts[j]), pa.array(score)], names=["text", "key", "first", "score"]
                        )
                if hi < len(kind):  # the block whose texts come next
                    names = pa.array(batch.column("keys")[int(hi)].as_py(), pa.string())
                    keys, firsts = Keys(names.to_pylist()), np.array(batch.column("firsts")[int(hi)].as_py(), np.int64)

    return both.mapInArrow(run, "text string, key string, first long, score double")


def _best(found: DataFrame, k: int, tie: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("text").orderBy(F.desc("score"), tie))
    return found.withColumn("r", rank).where(F.col("r") <= k).drop("r")


def _empty(frame: DataFrame) -> DataFrame:
    return frame.sparkSession.createDataFrame([], "text string, id long, score double")


def top_k(texts: DataFrame, keys: DataFrame, k: int, least: float = -1.0) -> DataFrame:
    """(text, id, score): for each distinct text the ``k`` best keys by token-sort ratio, ties to smaller ids; of these
    only those whose ratio is ``least`` or more, so a text asks no block that cannot reach it.

    ``texts`` has the column text; ``keys`` has id and key. Texts and keys of the same tokens are
    searched once. The result is staged.
    """
    with staging(texts.sparkSession):
        named = stage(texts.where("text is not null").select("text").distinct().withColumn("sorted", sort_tokens(F.col("text"))), "texts")
        held = keys.where("key is not null").select(F.col("id").cast("long").alias("id"), sort_tokens(F.col("key")).alias("key"))
        rank = F.row_number().over(Window.partitionBy("key").orderBy("id"))
        held = stage(held.withColumn("r", rank).where(F.col("r") <= k), "keys")  # of one key no more ids can be among the k
        index = build(held.where("r = 1").select("key", F.col("id").alias("first")))
        if index is None:
            return _empty(texts)
        asked = spread(named.select(F.col("sorted").alias("text")).distinct().withColumn("floor", F.lit(float(least))))
        probes = _best(_asked(stage(_visits(asked, index, max(FIRST, 4 * k)), "probes"), index, k, probe=True), k, "first")
        floor = probes.groupBy("text").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(float(least)).alias("floor"))
        floor = asked.select("text").join(floor, "text", "left").select("text", F.coalesce("floor", F.lit(float(least))).alias("floor"))
        visits = stage(_visits(spread(stage(floor, "floors")), index), "visits")
        best = _best(_asked(visits, index, k), k, "first")
        found = best.join(held.select("key", "id"), "key").select("text", "id", "score")
        found = _best(found, k, "id").withColumnRenamed("text", "sorted")
        return outlive(stage(named.join(found, "sorted").select("text", "id", "score"), "found"))


def at_least(texts: DataFrame, keys: DataFrame, cutoff: float) -> DataFrame:
    """(text, id, score): the keys (id, key) whose ratio to a distinct text reaches ``cutoff``. Staged."""
    with staging(texts.sparkSession):
        held = stage(keys.where("key is not null").select(F.col("id").cast("long").alias("id"), "key"), "keys")
        index = build(held.groupBy("key").agg(F.min("id").alias("first")))
        if index is None:
            return _empty(texts)
        asked = spread(texts.where("text is not null").select("text").distinct().withColumn("floor", F.lit(float(cutoff))))
        visits = stage(_visits(asked, index), "visits")
        found = _asked(visits, index, None).join(held, "key").select("text", "id", "score")
        return outlive(stage(found, "found"))
