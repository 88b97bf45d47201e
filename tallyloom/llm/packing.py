"""Token-id output: documents packed into fixed-length rows by best-fit decreasing.

Documents longer than a row are split losslessly into pieces of a row's length and a rest.
Pieces are packed in windows of at most WINDOW_PIECES pieces or WINDOW_TOKENS tokens of a
partition, longest first, each into the fullest row that has room. A segment tree over
capacities finds that row in log2(length) steps. Memory is bounded by a window; no shuffle
takes place, and a lost partition is packed again from its input alone.

A packed row holds the ids (little-endian, padded), cumulative segment lengths as attention
kernels take them (starting with 0, without the padding), position resets (the places where
positions begin again at 0), and of each segment its document and the token it begins with.

Defined results: a null or empty list of ids has the end-of-text id alone. Repeated rows are
packed as often as they occur. A null document id stays null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, text_buffers

WINDOW_PIECES, WINDOW_TOKENS = 16_384, 8 << 20
PAD, EOS, FIRST_BYTE = 0, 1, 2


class Capacities:
    """A segment tree over capacities 0..length: how many open rows have each one."""

    def __init__(self, length: int):
        self.leaves = 1 << length.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def _add(self, capacity: int, by: int) -> None:
        at, count = capacity + self.leaves, self.count
        while at:
            count[at] += by
            at >>= 1

    def put(self, row: int, capacity: int) -> None:
        self.rows[capacity].append(row)
        self._add(capacity, 1)

    def take(self, least: int) -> tuple[int, int] | None:
        """Remove a row of the smallest capacity that is ``least`` or more."""
        at, count = least + self.leaves, self.count
        if not count[at]:
            while at > 1 and (at & 1 or not count[at + 1]):  # up to where a right sibling has some
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if count[2 * at] else 2 * at + 1
        capacity = at - self.leaves
        self._add(capacity, -1)
        return self.rows[capacity].pop(), capacity


def best_fit_decreasing(lengths: np.ndarray, size: int) -> list[list[int]]:
    """Rows of indexes of ``lengths`` (each 1..size), none over ``size`` in total."""
    tree, rows = Capacities(size), []
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        found = tree.take(need)
        if found:
            row, capacity = found
            rows[row].append(i)
        else:
            row, capacity = len(rows), size
            rows.append([i])
        if capacity > need:
            tree.put(row, capacity - need)
    return rows


def pieces(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, first token and length of each piece."""
    counts = np.maximum(1, -(-lengths // size))
    doc = np.repeat(np.arange(len(lengths)), counts)
    start = (np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)) * size
    return doc, start, np.minimum(lengths[doc] - start, size)


def _packed(ids: np.ndarray, offsets: np.ndarray, doc_ids: pa.Array, size: int, kind, prefix: str, first: int) -> pa.RecordBatch:
    doc, start, length = pieces(np.diff(offsets), size)
    rows = best_fit_decreasing(length, size)
    flat = np.concatenate([np.array(r, np.int64) for r in rows])
    per_row = np.array([len(r) for r in rows])
    ends = np.cumsum(per_row)
    total = np.concatenate([[0], np.cumsum(length[flat])])
    within = total[:-1] - np.repeat(total[ends - per_row], per_row)
    matrix = np.full((len(rows), size), PAD, kind)
    target = matrix.reshape(-1)
    row_of = np.repeat(np.arange(len(rows)), per_row)
    for at, source, n in zip((row_of * size + within).tolist(), (offsets[doc[flat]] + start[flat]).tolist(), length[flat].tolist()):
        target[at : at + n] = ids[source : source + n]
    list_at = pa.array(np.concatenate([[0], ends]).astype(np.int32))
    fences = np.insert(within + length[flat], ends - per_row, 0)  # 0, then the end of each segment
    fence_at = pa.array(np.concatenate([[0], np.cumsum(per_row + 1)]).astype(np.int32))
    width = size * matrix.itemsize
    raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(rows), [None, pa.py_buffer(target)])
    return pa.RecordBatch.from_arrays(
        [
            pa.array([f"{prefix}-{first + i}" for i in range(len(rows))]),
            raw.cast(pa.binary()),
            pa.array(total[ends] - total[ends - per_row], pa.int32()),
            pa.ListArray.from_arrays(fence_at, pa.array(fences.astype(np.int32))),
            pa.ListArray.from_arrays(list_at, pa.array(within.astype(np.int32))),
            pa.ListArray.from_arrays(list_at, doc_ids.take(pa.array(doc[flat]))),
            pa.ListArray.from_arrays(list_at, pa.array(start[flat].astype(np.int64))),
        ],
        names=[f.split()[0] for f in SCHEMA.split(", ")],
    )


SCHEMA = (
    "pack_id string, ids binary, n_tokens int, cu_seqlens array<int>, position_resets array<int>, "
    "doc_ids array<bigint>, token_starts array<bigint>"
)


def pack(docs: DataFrame, size: int = 8192, ids: str | None = None, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Packed rows of ``size`` ids. The ids come from the column ``ids`` (array of int, stored
    as uint32) or, without one, from the UTF-8 bytes of ``text`` (byte b as b + 2, uint16);
    each document ends with id 1, id 0 is padding."""
    column = F.col(ids) if ids else F.col(text)
    source = docs.select(F.col(id).cast("long").alias("id"), column.alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        prefix, made = f"{TaskContext.get().partitionId():06d}", 0
        held, n_docs, n_ids = [], 0, 0
        for batch in batches:
            for values, offsets, names in _with_end(batch, bool(ids)):
                held.append((values, np.diff(offsets), names))
                n_docs, n_ids = n_docs + len(names), n_ids + len(values)
                if n_docs >= WINDOW_PIECES or n_ids >= WINDOW_TOKENS:
                    yield (out := window(held, prefix, made))
                    made += out.num_rows
                    held, n_docs, n_ids = [], 0, 0
        if held:
            yield window(held, prefix, made)

    def window(held: list, prefix: str, made: int) -> pa.RecordBatch:
        values = np.concatenate([h[0] for h in held])
        offsets = np.concatenate([[0], np.cumsum(np.concatenate([h[1] for h in held]))])
        names = pa.concat_arrays([h[2] for h in held])
        return _packed(values, offsets, names, size, np.dtype("<u4" if ids else "<u2"), prefix, made)

    return arrow(source).mapInArrow(run, SCHEMA)


def _with_end(batch: pa.RecordBatch, tokens: bool) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
    """Ids with an end after each document, by parts of a batch of about a megabyte."""
    for lo in range(0, batch.num_rows, 256):
        part = batch.slice(lo, 256)
        x = part.column("x")
        if tokens:
            lists = [[] if v is None else v for v in x.to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(v) for v in lists])]).astype(np.int64)
            flat = np.array([i for v in lists for i in v], np.uint32)
        else:
            data, offsets = text_buffers(x)
            flat = data.astype(np.uint16) + FIRST_BYTE
        values = np.insert(flat, offsets[1:], EOS)
        yield values, offsets + np.arange(len(offsets)), part.column("id")


def position_ids(n_tokens: int, resets: list[int]) -> np.ndarray:
    """Positions of a row's tokens, counted anew from each reset."""
    at = np.arange(n_tokens)
    begins = np.array(resets)
    return at - begins[np.searchsorted(begins, at, "right") - 1]


def unpack(packed: DataFrame, size: int = 8192, wide: bool = False) -> DataFrame:
    """(doc_id, token_start, ids) of every segment: what was packed, in pieces."""
    kind = np.dtype("<u4" if wide else "<u2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                values, cu = np.frombuffer(row["ids"], kind), row["cu_seqlens"]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["doc_ids"], pa.int64()),
                        pa.array(row["token_starts"], pa.int64()),
                        pa.array([values[a:b].tolist() for a, b in zip(cu, cu[1:])], pa.list_(pa.int32())),
                    ],
                    names=["doc_id", "token_start", "ids"],
                )

    return packed.mapInArrow(run, "doc_id long, token_start long, ids array<int>")
