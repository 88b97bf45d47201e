"""Line dedup: fuzzy lines by MinHash, in DataFrame functions only.

A line's shingles are its runs of five characters, lower-cased, one at every character; a line of
fewer characters is its own shingle. Each of POSITIONS minima orders the shingles' 64-bit
hashes anew (by a rotation and an exclusive-or). Two lines of similarity s agree in a position with probability s; BANDS bands
of ROWS positions (the rows, columns and diagonals of a square, so two bands share one position at most) make a pair of
similarity 0.8 candidates with probability 0.976, of 0.85 with 0.996, of 0.9 with 0.9998; lines that share only common
shingles seldom meet. Candidates are confirmed by the exact Jaccard similarity of
their shingle sets. Distributed union-find makes components, each of which keeps the first of its
lines by (document, line number).

Minima are taken before any shuffle: what moves is one signature for each distinct line of an input
partition, never a text. Two bits of SKETCHED positions form a sketch that goes with a line's band keys, so
candidates that differ in more than FAR of them are dropped before any text is read (at similarity 0.8 a
candidate does so with probability 2e-4). A bucket costs no pairs within a component: its lines are first linked to
its smallest, then, where it still spans components, to a line of another one, and only what
still spans is joined, across components. Parities of the two shingle sets, found once for each line that any other may be near
by its sketch, bound both of these steps without the loss of a pair, so what is confirmed follows the pairs that are near and not the square of a
bucket's lines. Confirming reads only lines that pass a bitmap of at most 2^BITMAP_BITS entries, which is
broadcast. Buckets are aggregated before they move and joined back, so a large one is split.

Defined results: lines end at \\n. Blank lines are always kept. Rows of one id are one document if
their texts are equal: repeated rows keep the same lines; rows of one id with different
texts are different documents, told apart by a 64-bit hash of the text. A null id comes before all others. A
null text has no lines, an empty one a blank line; an empty table has no lines. Very long lines are hashed in a
stream; only to confirm a pair are a line's hashes held. Equal lines have a similarity of 1. Lines are told apart by a
64-bit hash. Extra columns are carried along by ``drop_repeats``.
"""

from __future__ import annotations

import random
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import outlive, stage, staging
from .components import components, far_end, named, spanning

SHINGLE = 5  # characters
ROWS = 6
BANDS = 3 * ROWS
POSITIONS = ROWS * ROWS
SKETCHED = 32  # positions of which two bits are in a sketch
FAR = 11  # of SKETCHED
STARS = 4  # ends of its buckets that a line is linked to at once
PASSES = 3  # over the bands, so that a third of them moves at a time
UNROLLED = 16  # shingles hashed in one row
ROTATIONS = [0, 21, 42]  # of a hash's bits, so that orders of few shingles differ, too
BITMAP_BITS = 20
HASHED = "shuffle_hash"  # for the side of a join that has one row a key and is the smaller: the other is not sorted
MINIMA = [f"m{j}" for j in range(POSITIONS)]
NAMES = [f"b{b}" for b in range(BANDS)]
PARITY = [f"p{k}" for k in range(16)]  # of 64 bits each
_random = random.Random(29)
_ORDERS = [_random.getrandbits(63) for _ in range(POSITIONS)]


def band_positions(band: int) -> list[int]:
    """The rows, the columns and the diagonals of a square of positions."""
    kind, n = divmod(band, ROWS)
    return [[n * ROWS + k, k * ROWS + n, k * ROWS + (n + k) % ROWS][kind] for k in range(ROWS)]


def occurrences(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, version, at, line, key): each line that is not blank, its number from 0 and its hash."""
    rows = docs.select(F.col(id).alias("doc"), F.xxhash64(text).alias("version"), F.posexplode(F.split(text, "\n")).alias("at", "line"))
    return rows.where(F.col("line").rlike(r"\S")).withColumn("key", F.xxhash64("line"))


def _characters(line: str) -> Column:
    """Four bytes a character, so that each has its place."""
    return F.encode(F.lower(line), "UTF-32")


def signatures(lines: DataFrame) -> DataFrame:
    """(key, sketch, b0 to b17) of each distinct line. All of it is idempotent: a line that occurs again changes nothing."""
    width = 4 * SHINGLE
    rows = lines.select("key", _characters("line").alias("u"))
    rows = rows.select("key", "u", F.greatest(F.length("u") - (width - 1), F.lit(1)).alias("last"))
    rows = rows.select("key", "u", "last", F.explode(F.expr(f"sequence(1, last, {4 * UNROLLED})")).alias("i"))
    hashes = [f"xxhash64(substring(u, least(i + {4 * k}, last), {width})) as h{k}" for k in range(UNROLLED)]
    rows = rows.selectExpr("key", *hashes)
    turned = [f"(shiftleft(h{k}, {r}) | shiftrightunsigned(h{k}, {64 - r})) as h{k}_{r}" if r else f"h{k} as h{k}_0" for r in ROTATIONS for k in range(UNROLLED)]
    rows = rows.selectExpr("key", *turned)
    found = []
    for j, (name, order) in enumerate(zip(MINIMA, _ORDERS)):
        r = ROTATIONS[j % len(ROTATIONS)]
        least = "least(" + ", ".join(f"h{k}_{r} ^ {order}L" for k in range(UNROLLED)) + ")"
        found.append(F.expr(f"min(cast(shiftright({least}, 32) as int)) as {name}"))
    signed = rows.groupBy("key").agg(*found)
    sketch = " | ".join(f"shiftleft(cast({name} & 3 as long), {2 * j})" for j, name in enumerate(MINIMA[:SKETCHED]))
    bands = [F.xxhash64(F.lit(b), *(MINIMA[j] for j in band_positions(b))) for b in range(BANDS)]
    return signed.select("key", F.expr(sketch).alias("sketch"), *(b.alias(name) for b, name in zip(bands, NAMES)))


def _apart(left: str, right: str) -> Column:
    """In how many positions two sketches differ."""
    d = F.col(left).bitwiseXOR(F.col(right))
    return F.bit_count(d.bitwiseOR(F.shiftrightunsigned(d, 1)).bitwiseAND(F.lit(0x5555555555555555)))


def _ends(pairs: DataFrame) -> DataFrame:
    """(key) of the lines in pairs (a, b)."""
    return pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()


def _texts(keys: DataFrame, lines: DataFrame) -> DataFrame:
    """(key, line) of some distinct keys. A staged table."""
    needed = stage(keys, "needed")
    bit = F.col("key").bitwiseAND(F.lit((1 << BITMAP_BITS) - 1).cast("long"))
    bitmap = F.broadcast(needed.select(bit.alias("bit")).distinct())
    near = lines.select("key", "line").join(bitmap, bit == F.col("bit"), "left_semi").join(needed.hint(HASHED), "key", "left_semi")
    return stage(near.groupBy("key").agg(F.first("line").alias("line")), "texts")


def _codes(u: str) -> str:
    """The hashes of the shingles of ``u``, a lambda variable or a field of one: so it is bound once. They are made distinct outside the lambda, in compiled code."""
    width = 4 * SHINGLE
    return f"transform(sequence(1, greatest(length({u}) - {width - 1}, 1), 4), i -> xxhash64(substring({u}, i, {width})))"


def parities(texts: DataFrame) -> DataFrame:
    """(key, n, p0 to p15) of distinct lines (key, line): the size of a line's shingle set, and which bits its shingles flip an odd number of times."""
    codes = texts.select("key", F.expr(f"transform(array(encode(lower(line), 'UTF-32')), u -> {_codes('u')})[0]").alias("codes"))
    codes = codes.select("key", F.array_distinct("codes").alias("codes"))
    each = codes.select("key", F.size("codes").alias("n"), F.explode("codes").alias("h"))
    flips = [F.expr(f"bit_xor(if((shiftrightunsigned(h, 6) & {len(PARITY) - 1}) = {k}, shiftleft(1L, cast(h & 63 as int)), 0L)) as {p}") for k, p in enumerate(PARITY)]
    return each.groupBy("key").agg(F.max("n").alias("n"), *flips)


def _could_reach(left: str, right: str, percent: int) -> Column:
    """No pair of the similarity fails: parities differ in no more bits than the sets in shingles."""
    flipped = F.lit(0)
    for p in PARITY:
        flipped = flipped + F.bit_count(F.col(f"{left}.{p}").bitwiseXOR(F.col(f"{right}.{p}")))
    return flipped * (100 + percent) <= (F.col(f"{left}.n") + F.col(f"{right}.n")) * (100 - percent)


def _bounded(pairs: DataFrame, exact: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that could reach the similarity, by the parities of their lines."""
    found = pairs
    for end in ("a", "b"):
        found = found.join(exact.select(F.col("key").alias(end), F.struct("n", *PARITY).alias(f"of_{end}")), end)
    return found.where(_could_reach("of_a", "of_b", percent)).select("a", "b")


def confirm(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose shingle sets reach the similarity. ``texts`` (key, line) holds their lines, each once."""
    # What moves is the text, which is smaller than the codes of its shingles.
    both = pairs.join(texts.select(F.col("key").alias("a"), F.col("line").alias("x")), "a")
    both = both.join(texts.select(F.col("key").alias("b"), F.col("line").alias("y")), "b")
    both = both.select("a", "b", F.struct(_characters("x").alias("x"), _characters("y").alias("y")).alias("p"))
    both = both.select("a", "b", F.expr(f"transform(array(p), p -> struct({_codes('p.x')} as x, {_codes('p.y')} as y))[0]").alias("p"))
    sizes = F.size(F.array_distinct("p.x")) + F.size(F.array_distinct("p.y"))
    shared = both.select("a", "b", sizes.alias("sizes"), F.size(F.array_intersect("p.x", "p.y")).alias("shared"))
    return shared.where((100 + percent) * F.col("shared") >= percent * F.col("sizes")).select("a", "b")


def _shared(signed: DataFrame, names: list[str]) -> DataFrame:
    """(band, key, sketch, lo, lo_sketch): the lines of each bucket of some bands that holds several, and its smallest."""
    bands = signed.select("key", "sketch", F.explode(F.array(*names)).alias("band"))
    ends = bands.groupBy("band").agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.min_by("sketch", "key").alias("lo_sketch"))
    return bands.join(ends.where("lo < hi").drop("hi").hint(HASHED), "band")


def _met(member: DataFrame) -> DataFrame:
    """(key) of the lines that share a bucket with a line of another component whose sketch is near."""
    near = F.expr("p.band = q.band and p.component <> q.component") & (_apart("p.sketch", "q.sketch") <= FAR)
    return member.alias("p").join(member.alias("q"), near, "left_semi").select("key").distinct()


def _across(member: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of a bucket's lines that are of different components and could reach the similarity, each in the first band that both share."""
    apart = F.expr("p.band = q.band and p.key < q.key and p.component <> q.component") & (_apart("p.sketch", "q.sketch") <= FAR)
    first = F.coalesce(*(F.when(F.col(f"p.{b}") == F.col(f"q.{b}"), F.col(f"p.{b}")) for b in NAMES))
    found = member.alias("p").join(member.alias("q"), apart & (F.col("p.band") == first) & _could_reach("p", "q", percent))
    return found.select(F.col("p.key").alias("a"), F.col("q.key").alias("b"))


def near_lines(lines: DataFrame, percent: int = 80) -> DataFrame:
    """(node, component) of the distinct lines that have a near line; component is a line's hash. A staged table."""
    with staging(lines.sparkSession):
        signed = stage(signatures(lines), "signatures")
        found = [stage(_shared(signed, NAMES[k::PASSES]), "hits") for k in range(PASSES)]
        hits = reduce(DataFrame.union, found)

        stars = hits.where("key <> lo").where(_apart("sketch", "lo_sketch") <= FAR).groupBy("key")
        stars = stars.agg(F.slice(F.array_sort(F.collect_set("lo")), 1, STARS).alias("ends"))
        stars = stage(stars.select(F.explode("ends").alias("a"), F.col("key").alias("b")), "stars")
        links = stage(confirm(stars, _texts(_ends(stars), lines), percent), "links")
        joined = components(links)

        hits = hits.select("band", "key", "sketch")
        member = stage(spanning(named(hits, joined.hint(HASHED), "key"), "band", "key", "sketch", hint=HASHED), "open")
        if member.isEmpty():
            return outlive(joined)
        # Every pair that is still to be confirmed, with an end or across components, is of these lines.
        texts = _texts(_met(member), lines)
        exact = stage(parities(texts), "parities")
        ends = member.withColumn("end", F.struct(far_end("key", "key").alias("key"), far_end("key", "sketch").alias("sketch")))
        ends = ends.where(_apart("sketch", "end.sketch") <= FAR).groupBy("key").agg(F.slice(F.array_sort(F.collect_set("end.key")), 1, STARS).alias("ends"))
        ends = ends.select("key", F.explode("ends").alias("end")).select(F.least("key", "end").alias("a"), F.greatest("key", "end").alias("b"))
        more = ends.distinct().join(stars, ["a", "b"], "left_anti")
        more = stage(_bounded(more, exact, percent), "stars")
        links = stage(links.union(confirm(more, texts, percent)), "links")
        joined = components(links)

        member = spanning(named(member.select("band", "key", "sketch"), joined.hint(HASHED), "key"), "band", "key", hint=HASHED).drop("lo", "hi")
        # Few of all signatures are of lines that were bounded, so they meet first.
        bounded = signed.drop("sketch").join(exact.hint(HASHED), "key")
        member = stage(member.join(bounded.hint(HASHED), "key"), "open")
        across = stage(_across(member, percent).join(stars.union(more), ["a", "b"], "left_anti"), "across")
        if across.isEmpty():
            return outlive(joined)
        return outlive(components(links.union(stage(confirm(across, texts, percent), "links"))))


def repeats(docs: DataFrame, percent: int = 80, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, version, at, first_doc, first_version, first_at): each line that is not blank, and the first of its component."""
    with staging(docs.sparkSession):
        lines = occurrences(docs, id, text)
        joined = near_lines(lines, percent)
        lines = outlive(stage(lines.select("doc", "version", "at", "key"), "lines"))
        firsts = lines.groupBy("key").agg(F.min(F.struct("doc", "version", "at")).alias("first"), F.count("*").alias("n"))
        firsts = firsts.join(joined, F.col("key") == F.col("node"), "left").where("n > 1 or node is not null")
        firsts = stage(firsts.select("key", "first", F.coalesce("component", "key").alias("component")), "firsts")
        heads = firsts.groupBy("component").agg(F.min("first").alias("head"))
        firsts = outlive(stage(firsts.join(heads, "component").select("key", "head"), "heads"))
        # A line alone in its component needs no head.
        placed = lines.join(firsts, "key", "left")
        own = F.struct("doc", "version", "at")
        placed = placed.select("doc", "version", "at", F.coalesce("head", own).alias("head"))
        return placed.select(
            "doc", "version", "at", F.col("head.doc").alias("first_doc"), F.col("head.version").alias("first_version"), F.col("head.at").alias("first_at")
        )


KEPT = "doc <=> first_doc and version = first_version and at = first_at"


def drop_repeats(docs: DataFrame, percent: int = 80, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with texts of the lines that stay. A document all of whose lines go is dropped."""
    with staging(docs.sparkSession):
        gone = repeats(docs, percent, id, text).where(f"not ({KEPT})")
        gone = gone.groupBy(F.col("doc").alias("__doc"), F.col("version").alias("__version")).agg(F.collect_set("at").alias("__gone"))
        gone = outlive(stage(gone, "gone"))
    joined = docs.join(gone, F.col(id).eqNullSafe(F.col("__doc")) & (F.xxhash64(text) == F.col("__version")), "left")
    joined = joined.withColumn("__lines", F.when(F.col("__gone").isNotNull(), F.split(text, "\n")))
    at = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), "__gone")
    stay = F.transform(at, lambda i: F.get("__lines", i))
    joined = joined.withColumn("__stay", F.when(F.col("__gone").isNotNull(), stay))
    joined = joined.where(F.col("__gone").isNull() | F.exists("__stay", lambda line: line.rlike(r"\S")))
    joined = joined.withColumn("__text", F.array_join("__stay", "\n"))
    values = {text: F.coalesce("__text", text), "n_chars": F.coalesce(F.char_length("__text").cast("long"), "n_chars")}
    return joined.select(*((values[c] if c in values else F.col(c)).alias(c) for c in docs.columns))
