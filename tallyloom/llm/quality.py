"""Quality classifier: a byte-level convolutional network in numpy.

A text is cut into overlapping chunks that cover all of it. In each chunk every filter is
applied at every byte and max-pooled; a text's probability is a logistic function of the
mean and the maximum of its chunks' pooled features. Filters and weights are learned
together by Adam on a bounded sample of labelled texts.

Defined results: null counts as the empty text, which is one chunk without bytes; without
labelled rows every score is 0.5. Repeated rows get equal scores; extra columns are carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import arrow, text_buffers

WIDTH, FILTERS, CHUNK, STRIDE = 6, 24, 256, 224
FEATURES = 2 * FILTERS + 2
GROUP = 96  # chunks that are convolved at once


@dataclass
class Network:
    filters: np.ndarray  # WIDTH x 256 x FILTERS: what each byte adds at each place of a window
    bias: np.ndarray
    weights: np.ndarray  # of the features of a text
    offset: float

    def pooled(self, chunks: np.ndarray, valid: np.ndarray, where: bool = False):
        """Max-pooled response of each chunk to each filter, and at which byte."""
        n = len(chunks)
        out = np.empty((n, FILTERS), np.float32)
        at = np.empty((n, FILTERS), np.int64) if where else None
        for lo in range(0, n, GROUP):
            part = chunks[lo : lo + GROUP]
            total = self.filters[0].take(part[:, :CHUNK], axis=0)
            step = np.empty_like(total)
            for k in range(1, WIDTH):
                np.take(self.filters[k], part[:, k : k + CHUNK], axis=0, out=step, mode="clip")
                total += step
            short = np.flatnonzero(valid[lo : lo + GROUP] < CHUNK)
            for i in short:
                total[i, valid[lo + i] :] = -1e9
            if where:
                at[lo : lo + GROUP] = best = total.argmax(axis=1)
                out[lo : lo + GROUP] = np.take_along_axis(total, best[:, None], axis=1)[:, 0]
            else:
                total.max(axis=1, out=out[lo : lo + GROUP])
        return out, at

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The probability of each text; long texts are convolved in parts."""
        n = len(offsets) - 1
        logits = np.empty(n)
        for lo in range(0, n, 64):
            part = offsets[lo : min(lo + 64, n) + 1]
            counts = chunk_counts(np.diff(part))
            ends = np.cumsum(counts)
            hidden = np.empty((int(ends[-1]), FILTERS), np.float32)
            for a in range(0, len(hidden), 8 * GROUP):
                chunks, valid = cut(data, part, counts, a, min(a + 8 * GROUP, len(hidden)))
                hidden[a : a + len(chunks)] = self.pooled(chunks, valid)[0]
            hidden = np.maximum(hidden + self.bias, 0)
            features = self.features(hidden, ends - counts, counts, np.diff(part))
            logits[lo : lo + len(counts)] = features @ self.weights + self.offset
        return 1 / (1 + np.exp(-np.clip(logits, -30, 30)))

    @staticmethod
    def features(hidden: np.ndarray, begins: np.ndarray, counts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Mean and maximum over a text's chunks, and how full its first chunk is: short
        texts have low maxima for want of bytes."""
        mean = np.add.reduceat(hidden, begins, axis=0) / counts[:, None]
        full = np.minimum(lengths, CHUNK)[:, None] / CHUNK
        return np.concatenate([mean, np.maximum.reduceat(hidden, begins, axis=0), full, np.sqrt(full)], axis=1)


def chunk_counts(lengths: np.ndarray) -> np.ndarray:
    return np.maximum(1, 1 + -(-(lengths - CHUNK) // STRIDE)).astype(np.int64)


def cut(data: np.ndarray, offsets: np.ndarray, counts: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """Chunks ``first`` to ``last`` of some texts (zero bytes after a text's end), and how
    many bytes of each are windows' beginnings (one at least)."""
    ends = np.cumsum(counts)
    wanted = np.arange(first, last)
    row = np.searchsorted(ends, wanted, "right")
    begin = offsets[row] + (wanted - (ends - counts)[row]) * STRIDE
    left = offsets[row + 1] - begin
    places = begin[:, None] + np.arange(CHUNK + WIDTH - 1)
    inside = places < offsets[row + 1][:, None]
    chunks = np.where(inside, data[np.minimum(places, max(len(data) - 1, 0))], 0) if len(data) else np.zeros(places.shape, np.uint8)
    return chunks.astype(np.intp), np.clip(left, 1, CHUNK)


def train(texts: pa.Array, labels: np.ndarray, epochs: int = 14, batch: int = 32, rate: float = 0.02, seed: int = 3) -> Network:
    rng = np.random.default_rng(seed)
    net = Network(
        rng.normal(0, 0.25, (WIDTH, 256, FILTERS)).astype(np.float32),
        np.zeros(FILTERS, np.float32), np.zeros(FEATURES), 0.0,
    )
    net.filters[:, 0] = 0
    n = len(labels)
    if n == 0 or labels.min() == labels.max():
        net.offset = 0.0 if n == 0 else (4.0 if labels[0] else -4.0)
        return net
    net.weights = rng.normal(0, 0.1, FEATURES)
    data, offsets = text_buffers(texts)
    weight = np.where(labels == 1, 1.0, np.sqrt(labels.sum() / (n - labels.sum())))  # between none and balanced
    steps, moments = 0, {}

    def adam(name: str, value, gradient, speed):
        m, v = moments.get(name, (0.0, 0.0))
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        moments[name] = m, v
        return value - (speed * (m / (1 - 0.9**steps)) / (np.sqrt(v / (1 - 0.999**steps)) + 1e-8)).astype(np.float32)

    for epoch in range(epochs):
        speed = rate * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
        order = rng.permutation(n)
        for lo in range(0, n, batch):
            rows = order[lo : lo + batch]
            own = np.concatenate([data[offsets[r] : offsets[r + 1]] for r in rows])
            at = np.concatenate([[0], np.cumsum(offsets[rows + 1] - offsets[rows])])
            counts = chunk_counts(np.diff(at))
            begins = np.cumsum(counts) - counts
            chunks, valid = cut(own, at, counts, 0, int(counts.sum()))
            raw, best = net.pooled(chunks, valid, where=True)
            hidden = np.maximum(raw + net.bias, 0)
            features = net.features(hidden, begins, counts, np.diff(at))
            p = 1 / (1 + np.exp(-np.clip(features @ net.weights + net.offset, -30, 30)))
            slope = weight[rows] * (p - labels[rows]) / len(rows)
            back = slope[:, None] * net.weights
            of = np.repeat(np.arange(len(rows)), counts)
            inner = (back[:, :FILTERS] / counts[:, None])[of]
            inner += back[:, FILTERS : 2 * FILTERS][of] * (hidden == features[:, FILTERS : 2 * FILTERS][of])
            inner *= hidden > 0
            steps += 1
            places = best[:, :, None] + np.arange(WIDTH)  # chunks x FILTERS x WIDTH
            byte = np.take_along_axis(chunks[:, None, :], places, axis=2)
            index = (np.arange(WIDTH) * 256 + byte) * FILTERS + np.arange(FILTERS)[:, None]
            gradient = np.bincount(index.ravel(), np.repeat(inner.ravel(), WIDTH), net.filters.size).reshape(net.filters.shape)
            gradient[:, 0] = 0
            net.weights = adam("weights", net.weights, features.T @ slope + 1e-4 * net.weights, speed)
            net.offset = float(adam("offset", np.float64(net.offset), slope.sum(), speed))
            net.bias = adam("bias", net.bias, inner.sum(axis=0), speed).astype(np.float32)
            net.filters = adam("filters", net.filters, gradient + 1e-5 * net.filters, speed).astype(np.float32)
    return net


def score(docs: DataFrame, net: Network, text: str = "text", score: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1."""
    docs = docs.select(*(f"`{c}`" for c in docs.columns if c != score))  # an older score gives way
    shared = docs.sparkSession.sparkContext.broadcast(net)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = shared.value.scores(*text_buffers(batch.column(text)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.float64())], names=[*batch.schema.names, score])

    return arrow(docs).mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(score, T.DoubleType())]))
