"""MinHash near-dedup by a multi-index Hamming join.

Every text becomes its set of distinct word shingles; texts with equal sets form one
class. A class has a signature of POSITIONS minima, of each of which SYMBOL_BITS bits
stay. The signature is cut into chunks of CHUNK symbols. If two signatures differ in at
most MAX_DISTANCE positions, some chunk has at most one error (the pigeonhole principle:
2 * chunks > MAX_DISTANCE), so leaving out each symbol of a chunk in turn gives both a
common key. At similarity 0.8 a pair is beyond MAX_DISTANCE with probability 6e-5, at
0.85 with 1e-8. Candidates within it are confirmed on the full sets.

Beside its signature a set has a parity sketch: each shingle flips one of PARITY_BITS bits.
Two sketches differ in no more bits than the sets differ in shingles, so pairs whose
sketches differ by more than the similarity allows are dropped without any loss.

Sets too small to have a partner of another set (under four shingles at 80 percent) need no keys.
Groups of many near copies cost no pairs within the group: each class is first linked to a
few of its buckets' smallest classes; in buckets that still span components, to a class of
another one; and what then still spans is joined, only across components and under the bounds on sizes
and parities, which loses no link between components. The join's condition has to stay small: beyond 8,000 bytes
of generated code the JVM would interpret it. Buckets over HOT_BUCKET
are refined by a second key from the other chunks, with up to two errors: complete by the
same principle. Buckets are aggregated before they move and joined back, so a large one is split.

Defined results: null and empty texts, and texts without words, have an empty set and
are linked with nothing; rows without an id take no part (component null, kept). Repeated
rows are copies. Very long texts are read in slices of words. Empty tables give no rows. Other columns are
carried along unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow, outlive, row_slices, stage, staging, text_buffers, unstage
from .components import components, far_end, named, spanning
from .words import SLICE_BYTES, mix, shingles, words

POSITIONS, CHUNK, SYMBOL_BITS = 70, 5, 8
CHUNKS = POSITIONS // CHUNK  # each in a long
MAX_DISTANCE = 2 * CHUNKS - 1
HOT_BUCKET = 20_000
STARS = 4  # smallest classes of its buckets that a class is first linked to
PARITY_ROWS = 256  # sketched at a time
SIGNATURE = [f"s{i}" for i in range(CHUNKS)]
PARITY_BITS = 1024
PARITY = [f"p{i}" for i in range(PARITY_BITS // 64)]

_rng = np.random.default_rng(7)
_XOR = _rng.integers(0, 2**63, POSITIONS, dtype=np.uint64)
_ODD = _rng.integers(0, 2**63, POSITIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _signature(row: np.ndarray, value: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Set sizes and symbols (rows x POSITIONS) of sets sorted by row."""
    counts = np.bincount(row, minlength=n_rows)
    symbols = np.zeros((n_rows, POSITIONS), np.uint64)
    full = counts > 0
    if full.any():
        begins = (np.cumsum(counts) - counts)[full]
        for k in range(POSITIONS):
            symbols[full, k] = mix(np.minimum.reduceat((value ^ _XOR[k]) * _ODD[k], begins))
    return counts, symbols & np.uint64((1 << SYMBOL_BITS) - 1)


def _pack(symbols: np.ndarray) -> np.ndarray:
    shifts = np.arange(CHUNK, dtype=np.uint64) * np.uint64(SYMBOL_BITS)
    return (symbols.reshape(len(symbols), CHUNKS, CHUNK) << shifts).sum(axis=2, dtype=np.uint64).astype(np.int64)


def _unpack(longs: np.ndarray) -> np.ndarray:
    shifts = np.arange(CHUNK, dtype=np.int64) * SYMBOL_BITS
    return ((longs[:, :, None] >> shifts) & ((1 << SYMBOL_BITS) - 1)).reshape(len(longs), POSITIONS)


def _parity(row: np.ndarray, value: np.ndarray, n_rows: int) -> np.ndarray:
    """Rows x longs: which bits the shingles of a set flip an odd number of times. ``row`` is sorted."""
    bit = (value >> np.uint64(64 - PARITY_BITS.bit_length() + 1)).astype(np.int64)
    found = np.zeros((n_rows, PARITY_BITS // 8), np.uint8)
    for lo in range(0, n_rows, PARITY_ROWS):
        hi = min(lo + PARITY_ROWS, n_rows)
        a, b = np.searchsorted(row, (lo, hi))
        flips = np.bincount((row[a:b] - lo) * PARITY_BITS + bit[a:b], minlength=(hi - lo) * PARITY_BITS)
        found[lo:hi] = np.packbits((flips & 1).astype(np.uint8).reshape(hi - lo, PARITY_BITS), axis=1)
    return found.view(np.int64)


def sets(docs: DataFrame, size: int, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n, a, b, signature, parity): size, two hashes and sketches of each row's shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, rows, h in words(batch.column("__text")):
                row, value = shingles(rows, h, hi - lo, size)
                counts, symbols = _signature(row, value, hi - lo)
                ends = np.cumsum(counts)
                sums = []
                for salt in (0x51, 0xA7):
                    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(value ^ np.uint64(salt)))])
                    sums.append((total[ends] - total[ends - counts]).view(np.int64))
                sketch = np.concatenate([_pack(symbols), _parity(row, value, hi - lo)], axis=1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("__id").slice(lo, hi - lo), pa.array(counts.astype(np.int64)), *map(pa.array, sums)]
                    + [pa.array(np.ascontiguousarray(column)) for column in sketch.T],
                    names=["id", "n", "a", "b", *SIGNATURE, *PARITY],
                )

    source = docs.select(F.col(id).cast("long").alias("__id"), F.col(text).alias("__text"))
    return arrow(source).mapInArrow(run, "id long, n long, a long, b long, " + ", ".join(f"{s} long" for s in SIGNATURE + PARITY))


def bucket_keys(classes: DataFrame) -> DataFrame:
    """(key, rep): the POSITIONS keys of each class, chunk by chunk with one symbol left out."""
    found = []
    for place in range(POSITIONS):
        c, left_out = divmod(place, CHUNK)
        kept = ((1 << CHUNK * SYMBOL_BITS) - 1) & ~(((1 << SYMBOL_BITS) - 1) << SYMBOL_BITS * left_out)
        found.append(F.col(f"s{c}").bitwiseAND(F.lit(kept)).bitwiseOR(F.lit(place << CHUNK * SYMBOL_BITS)))
    return classes.select(F.explode(F.array(*found)).alias("key"), "rep")


def _refined(rows: DataFrame) -> DataFrame:
    """(key, rep, component): hot buckets' rows under second keys, the other chunks with two symbols left out."""
    kept = list(combinations(range(CHUNK), CHUNK - 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                symbols = _unpack(np.stack([part.column(s).to_numpy() for s in SIGNATURE], axis=1)).astype(np.uint64)
                first = part.column("key").to_numpy().astype(np.uint64)
                own = (first >> np.uint64(SYMBOL_BITS * CHUNK)).astype(np.int64) // CHUNK
                for c in range(CHUNKS):
                    other = pa.array(own != c)
                    for n, places in enumerate(kept):
                        second = np.full(len(first), c * len(kept) + n, np.uint64)
                        for p in places:
                            second = (second << np.uint64(SYMBOL_BITS)) | symbols[:, c * CHUNK + p]
                        key = mix(mix(first) ^ second).view(np.int64)
                        out = pa.RecordBatch.from_arrays([pa.array(key), part.column("rep"), part.column("component")], names=["key", "rep", "component"])
                        yield out.filter(other)

    return rows.select("key", "rep", "component", *SIGNATURE).mapInArrow(run, "key long, rep long, component long")


def _differing(left: str, right: str, c: int) -> Column:
    """A bit (the highest of its byte) for each symbol in which chunk ``c`` differs."""
    low, high = F.lit(0x7F7F7F7F7F), F.lit(0x8080808080)
    d = F.col(f"{left}.s{c}").bitwiseXOR(F.col(f"{right}.s{c}"))
    return (d.bitwiseAND(low) + low).bitwiseOR(d).bitwiseAND(high)


def _sizes(left: str, right: str, percent: int) -> Column:
    """Sizes that allow the similarity."""
    n, m = F.col(f"{left}.n"), F.col(f"{right}.n")
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def _distant(left: str, right: str) -> Column:
    distance = F.lit(0)
    for c in range(CHUNKS):
        distance = distance + F.bit_count(_differing(left, right, c))
    return distance > MAX_DISTANCE


def _parities(left: str, right: str, percent: int) -> Column:
    """No pair that reaches the similarity fails: sketches differ in no more bits than the sets in shingles."""
    flipped = F.lit(0)
    for p in PARITY:
        flipped = flipped + F.bit_count(F.col(f"{left}.{p}").bitwiseXOR(F.col(f"{right}.{p}")))
    return flipped * (100 + percent) <= (F.col(f"{left}.n") + F.col(f"{right}.n")) * (100 - percent)


def confirm(pairs: DataFrame, docs: DataFrame, size: int, percent: int, id: str, text: str) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""
    needed = stage(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "needed")
    texts = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    texts = stage(texts.join(needed, "id", "left_semi"), "texts")
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("x")), "a")
    both = both.join(texts.select(F.col("id").alias("b"), F.col("text").alias("y")), "b").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = [text_buffers(batch.column(c))[1] for c in ("x", "y")]
            for lo, hi in row_slices(ends[0] + ends[1], 2 * SLICE_BYTES):
                part = batch.slice(lo, hi - lo)
                n_rows, found = hi - lo, []
                for c in ("x", "y"):
                    row, value = [], []
                    for a, b, rows, h in words(part.column(c)):
                        r, v = shingles(rows, h, b - a, size)
                        row.append(r + a)
                        value.append(v)
                    found.append((np.concatenate(row), np.concatenate(value)))
                row = np.concatenate([found[0][0], found[1][0]])
                value = np.concatenate([found[0][1], found[1][1]])
                order = np.lexsort((value, row))
                row, value = row[order], value[order]
                same = (row[1:] == row[:-1]) & (value[1:] == value[:-1])
                shared = np.bincount(row[1:][same], minlength=n_rows)
                union = np.bincount(row, minlength=n_rows) - shared
                keep = pa.array((100 * shared >= percent * union) & (shared > 0))
                yield part.select(["a", "b"]).filter(keep)

    return arrow(both).mapInArrow(run, "a long, b long").distinct()


def near_duplicates(
    docs: DataFrame, shingle_words: int = 5, percent: int = 80, id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(id, n_shingles, component_id) of every row of ``docs``."""
    with staging(docs.sparkSession):
        every = stage(sets(docs, shingle_words, id, text), "sets")
        first = [F.first(s).alias(s) for s in SIGNATURE + PARITY]
        classes = stage(
            every.where("n > 0 and id is not null").groupBy("n", "a", "b").agg(F.min("id").alias("rep"), *first), "classes"
        )
        every = stage(every.select("id", "n", "a", "b"), "slim")
        joined = _linked(classes, docs, shingle_words, percent, id, text)
        component = named(classes.select("n", "a", "b", "rep"), joined, "rep").select("n", "a", "b", "component")
        out = every.alias("e").join(component.alias("c"), F.expr("e.n = c.n and e.a = c.a and e.b = c.b and e.id is not null"), "left")
        found = out.select(
            F.col("e.id").alias(id), F.col("e.n").alias("n_shingles"), F.coalesce("c.component", "e.id").alias("component_id")
        )
        return outlive(stage(found, "near"))


def _linked(classes: DataFrame, docs: DataFrame, size: int, percent: int, id: str, text: str) -> DataFrame:
    """(node, component) of the classes that have a link."""
    signed = classes.select("rep", "n", *SIGNATURE, *PARITY)
    # A set of n shingles has a partner of another set only if one of n + 1 would do.
    keys = bucket_keys(signed.where(F.col("n") * 100 >= (F.col("n") + 1) * percent))
    shared = keys.groupBy("key").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi")
    hits = stage(keys.join(shared, "key"), "hits")

    few = F.slice(F.array_sort(F.collect_set("lo")), 1, STARS)  # of at most POSITIONS
    stars = hits.where("rep <> lo").groupBy("rep").agg(few.alias("ends")).select(F.col("rep").alias("b"), F.explode("ends").alias("a"))
    links = _confirmed(stars, signed, docs, size, percent, id, text)
    joined = components(links)

    hits = hits.select("key", "rep")
    member = stage(spanning(named(hits, joined, "rep"), "key", "rep"), "open")
    if member.isEmpty():
        return joined
    ends = F.slice(F.array_sort(F.collect_set(far_end("rep", "rep"))), 1, STARS)
    stars = member.groupBy("rep").agg(ends.alias("ends")).select("rep", F.explode("ends").alias("end"))
    stars = stars.select(F.least("rep", "end").alias("a"), F.greatest("rep", "end").alias("b")).distinct()
    links = stage(links.union(_confirmed(stars, signed, docs, size, percent, id, text)), "links")
    joined = components(links)

    member = spanning(named(member.select("key", "rep"), joined, "rep"), "key", "rep").drop("lo", "hi")
    across = _across(stage(member.join(signed, "rep"), "open"), percent)
    more = _confirmed(across, signed, docs, size, percent, id, text)
    return joined if more.isEmpty() else components(links.union(more))


def _across(member: DataFrame, percent: int) -> DataFrame:
    """Near pairs (a, b) of a bucket's rows that are of different components, each once."""
    side = member.where(F.col("size") <= HOT_BUCKET)
    apart = F.expr("p.key = q.key and p.rep < q.rep and p.component <> q.component")
    pair = [F.col("p.rep").alias("a"), F.col("q.rep").alias("b")]
    across = side.alias("p").join(side.alias("q"), apart & _sizes("p", "q", percent) & _parities("p", "q", percent)).select(*pair).distinct()
    hot = member.where(F.col("size") > HOT_BUCKET)
    if hot.isEmpty():
        return across
    finer = stage(_refined(hot), "refined")  # slim rows, as there are many: their pairs are pruned later
    return across.union(finer.alias("p").join(finer.alias("q"), apart).select(*pair)).distinct()


def _confirmed(pairs: DataFrame, signed: DataFrame, docs: DataFrame, size: int, percent: int, id: str, text: str) -> DataFrame:
    """The links among ``pairs``: pruned by signatures and parities, which lose none, then confirmed."""
    both = pairs.join(signed.alias("p"), F.col("a") == F.col("p.rep")).join(signed.alias("q"), F.col("b") == F.col("q.rep"))
    both = stage(both.where(_sizes("p", "q", percent) & _parities("p", "q", percent) & ~_distant("p", "q")).select("a", "b"), "pairs")
    links = stage(confirm(both, docs, size, percent, id, text), "links")
    unstage(both)
    return links


def keep_one(docs: DataFrame, shingle_words: int = 5, percent: int = 80, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows whose component has a smaller id; one row of each id stays.

    Of rows that share an id the first by a hash of its text stays, of equal texts an arbitrary one. Rows
    without an id all stay.
    """
    with staging(docs.sparkSession):
        found = near_duplicates(docs, shingle_words, percent, id, text).where(F.col(id).isNotNull())
        each = found.groupBy(F.col(id).alias("__id")).agg((F.min("component_id") < F.col(id)).alias("__copy"), (F.count("*") > 1).alias("__again"))
        gone = outlive(stage(each.where("__copy or __again"), "gone"))
        again = gone.where("not __copy")
        rest = docs.join(gone, F.col(id) == F.col("__id"), "left_anti")
        if again.isEmpty():
            return rest
        rows = docs.join(again, F.col(id) == F.col("__id"), "left_semi")
        row = F.struct(*(F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)))
        ones = rows.groupBy(F.col(id).alias("__id")).agg(F.min_by(row, F.xxhash64(text)).alias("row"))
        return rest.union(ones.select(*(F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns))))
