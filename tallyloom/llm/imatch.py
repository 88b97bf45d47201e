"""Document fingerprints by I-Match, in DataFrame functions only.

Terms (lower-cased runs of letters and digits) count if their document frequency is in a
band: at least ``low`` of all documents (twice at least), at most ``high``. A fingerprint
has LEXICONS hashes for each of several rates; each hashes the document's sorted distinct
band terms that are in one randomised subset of the lexicon, which holds one term in
``rate``. Long texts agree in sparse subsets, short ones in dense ones.

A group of near copies that holds more than ``high`` of the rows lifts its own terms above the
band. So a text with few band terms adds the rarest of its terms above the band to the lexicon,
where they count for every text.

The lexicon has at most (mean distinct terms) / ``low`` entries, whatever the number
of documents; it is counted, and broadcast up to MAX_BROADCAST entries, joined by a shuffle
beyond. A text is shuffled once, to stand beside the next document; nothing else is but
term counts.

Likeness of two fingerprints: 1 if equal; else, over the rates at which at least ENOUGH
subsets hold a term of either, the largest share of them whose hashes are equal (over all
rates together, if none has enough).

Defined results: null counts as the empty text. A text without terms in any subset has the
hash of the whole text as its fingerprint. Rows without an id come after all others, equal
ids stand in the order of a hash of their texts; repeated rows get equal fingerprints.
Extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

LEXICONS = 16
RATES = (32, 128, 512)
ENOUGH = 4
MAX_BROADCAST = 2_000_000
FEW = 4  # a text has few band terms if they are under one in FEW of its frequent enough ones
RAREST = 64
LEAST_LEVEL = 16  # squared: ranges of ids, at least
RANGE_BYTES = 128 << 20


def _shift(k: int) -> int:
    return sum(r.bit_length() - 1 for r in RATES[:k])


def _subset(code: Column, k: int) -> Column:
    """Which subset of rate k a term is in; LEXICONS or more: none."""
    return F.shiftrightunsigned(code, _shift(k)).bitwiseAND(F.lit(RATES[k] - 1).cast("long"))


def term_codes(text: Column) -> Column:
    """Distinct 60-bit codes of a text's terms that are in any subset."""
    words = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    codes = F.transform(F.filter(words, lambda w: w != ""), lambda w: F.shiftrightunsigned(F.xxhash64(w), 4))

    def used(c: Column) -> Column:
        inside = _subset(c, 0) < LEXICONS
        for k in range(1, len(RATES)):
            inside = inside | (_subset(c, k) < LEXICONS)
        return inside

    return F.array_distinct(F.filter(codes, used))


def band(docs: DataFrame, text: str, low: float, high: float) -> DataFrame:
    """The codes of terms whose document frequency is in the band, and for each text that has
    few of them its RAREST rarest terms above the band."""
    n = docs.count()
    rows = docs.select(F.xxhash64(F.coalesce(text, F.lit(""))).alias("t"), term_codes(F.col(text)).alias("codes"))
    each = rows.select("t", F.explode("codes").alias("code"))
    least = max(2, int(low * n))
    most = max(least, int(high * n))
    known = stage(each.groupBy("code").count().where(F.col("count") >= least), "known")
    inside = known.where(F.col("count") <= most).select("code")
    above = known.where(F.col("count") > most)
    if above.isEmpty():
        return inside
    small = known.count() <= MAX_BROADCAST
    marked = known.select("code", (F.col("count") <= most).alias("inside"))
    found = each.join(F.broadcast(marked) if small else marked, "code").groupBy("t")
    found = found.agg(F.count_if("inside").alias("n_inside"), F.count("*").alias("n_known"))
    bare = stage(found.where(FEW * F.col("n_inside") < F.col("n_known")).select("t"), "bare")
    if bare.isEmpty():
        return inside
    rarest = above.agg(F.transform(F.array_sort(F.collect_list(F.struct("count", "code"))), lambda c: c["code"]).alias("above"))
    wanted = F.slice(F.array_intersect("above", "codes"), 1, RAREST)
    more = rows.join(bare, "t", "left_semi").crossJoin(F.broadcast(rarest)).select(wanted.alias("wanted")).distinct()
    more = more.select(F.explode("wanted").alias("code")).distinct()  # near copies share most of their lists
    return stage(inside.union(more), "lexicon")


def _level(rows: DataFrame) -> int:
    """The root of how many ranges of ids hold about RANGE_BYTES of text each."""
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return max(LEAST_LEVEL, math.ceil(math.sqrt(size / RANGE_BYTES)))


def _ranges(docs: DataFrame, key: Column, level: int) -> Column:
    """The range of ids that ``key`` is in, by quantiles in two steps. The quantiles (eight bytes a range) are one literal."""
    parts = level**2
    shares = [i / parts for i in range(1, parts)]
    bounds = docs.agg(F.percentile_approx(key, shares, max(10_000, 4 * parts)).alias("b")).first()["b"] or []

    def literal(values: list[int]) -> Column:  # folded before the job, unlike from_json, which would be parsed for each row
        return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>") if values else F.array().cast("array<bigint>")

    at = F.size(F.filter(literal(bounds[level - 1 :: level]), lambda b: b <= key))
    fine = F.slice(literal(bounds), at * level + 1, level - 1)
    return at * level + F.size(F.filter(fine, lambda b: b <= key))


def beside_next(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(bucket, n, ghost, id, text, next): each document and the text of the next one by
    descending id (after the last, the first). ``bucket`` and ``n`` name a row; a ghost
    stands for a neighbour bucket's document."""
    key = F.coalesce(F.col(id).cast("long"), F.lit(-(2**63)))
    rows = docs.select(F.col(id).cast("long").alias("id"), F.coalesce(text, F.lit("")).alias("text"), key.alias("key"))
    bucket = _ranges(rows, F.col("key"), _level(rows))
    lasts = rows.groupBy(bucket.alias("bucket")).agg(F.max("key").alias("key")).orderBy("bucket").collect()
    target = {r["key"]: lasts[(i + 1) % len(lasts)]["bucket"] for i, r in enumerate(lasts)}  # one for each range of RANGE_BYTES
    spark = docs.sparkSession
    ghosts = F.broadcast(spark.createDataFrame(list(target.items()), "last long, target int"))
    places = F.array(F.struct(bucket.alias("bucket"), F.lit(False).alias("ghost")), F.struct(F.col("target").alias("bucket"), F.lit(True).alias("ghost")))
    dealt = rows.join(ghosts, F.col("key") == F.col("last"), "left").withColumn("place", F.explode(places))
    dealt = dealt.select("place.*", "id", "key", "text").where("bucket is not null")
    order = Window.partitionBy("bucket").orderBy(F.desc("ghost"), "key", F.xxhash64("text"))
    return dealt.select(
        "bucket", F.row_number().over(order).alias("n"), "ghost", "id", "text", F.lag("text").over(order).alias("next")
    )


def _hashes(codes: Column) -> Column:
    """The hash of each subset's codes (sorted), 0 where it has none: one array."""
    subsets = F.sequence(F.lit(0).cast("long"), F.lit(LEXICONS - 1).cast("long"))

    def of_rate(k: int) -> Column:
        def hashed(own: Column) -> Column:
            return F.when(F.size(own) == 0, F.lit(0).cast("long")).otherwise(F.xxhash64(own))

        def each(mine: Column) -> Column:
            return F.transform(subsets, lambda j: let(F.filter(mine, lambda c: _subset(c, k) == j), hashed))

        return let(F.filter(codes, lambda c: _subset(c, k) < LEXICONS), each)

    return F.concat(*(of_rate(k) for k in range(len(RATES))))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _string(hashes: Column, text_hash: Column) -> Column:
    empty = F.forall(hashes, lambda h: h == 0)
    joined = F.array_join(F.transform(hashes, lambda h: F.substring(F.lpad(F.hex(h), 16, "0"), 9, 8)), "")
    return F.when(empty, F.concat(F.lit("text:"), text_hash)).otherwise(joined)


def likeness(a: Column, b: Column) -> Column:
    """Of two arrays of subset hashes."""
    pairs = F.arrays_zip(a.alias("a"), b.alias("b"))
    shares, all_either, all_same = [], F.lit(0), F.lit(0)
    for k in range(len(RATES)):
        part = F.slice(pairs, k * LEXICONS + 1, LEXICONS)
        either = F.size(F.filter(part, lambda p: (p["a"] != 0) | (p["b"] != 0)))
        same = F.size(F.filter(part, lambda p: (p["a"] != 0) & (p["a"] == p["b"])))
        shares.append(F.when(either >= ENOUGH, same / either))
        all_either, all_same = all_either + either, all_same + same
    best = F.greatest(*shares)
    return F.coalesce(best, F.when(all_either > 0, all_same / all_either), F.lit(0.0))


def fingerprints(docs: DataFrame, low: float = 1 / 2000, high: float = 0.05, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next): of
    each text and of its edited text, whose last third (rounded down) is the first as many
    characters of the next document."""
    lexicon = band(docs, text, low, high)
    if lexicon.count() <= MAX_BROADCAST:
        lexicon = F.broadcast(lexicon)
    rows = beside_next(docs, id, text)
    n = F.char_length("text")
    third = F.floor(n / 3).cast("int")
    rows = rows.withColumn("edited", F.concat(F.expr("substring(text, 1, char_length(text) - cast(floor(char_length(text) / 3) as int))"), F.substring(F.coalesce("next", F.lit("")), F.lit(1), third)))
    flag = lambda text, bit: F.transform(term_codes(F.col(text)), lambda c: F.shiftleft(c, 2).bitwiseOR(F.lit(bit).cast("long")))
    rows = rows.select(
        "bucket", "n", "ghost", "id", n.cast("long").alias("n_chars"), F.unhex(F.sha2("text", 256)).alias("sha"),
        F.unhex(F.sha2("edited", 256)).alias("edited_sha"),
        F.explode(F.concat(F.array(F.lit(0).cast("long")), flag("text", 1), flag("edited", 2))).alias("coded"),
    )
    head = F.col("coded") == 0
    marks = [F.when(head, F.col(c)).alias(c) for c in ("id", "n_chars", "sha", "edited_sha")]
    rows = rows.select("bucket", "n", "ghost", *marks, "coded", F.shiftrightunsigned("coded", 2).alias("own"))
    known = rows.join(lexicon, F.col("own") == F.col("code"), "left").where(head | F.col("code").isNotNull())
    one = known.groupBy("bucket", "n", "ghost").agg(
        *(F.max(c).alias(c) for c in ("id", "n_chars", "sha", "edited_sha")), F.array_sort(F.collect_list("coded")).alias("codes")
    )
    having = lambda bit: F.transform(
        F.filter("codes", lambda c: c.bitwiseAND(F.lit(bit).cast("long")) != 0), lambda c: F.shiftrightunsigned(c, 2)
    )
    one = one.withColumn("h", _hashes(having(1))).withColumn("e", _hashes(having(2)))
    order = Window.partitionBy("bucket").orderBy("n")
    one = one.withColumn("next_h", F.lag("h").over(order)).withColumn("next_sha", F.lag("sha").over(order)).where("not ghost")
    bare = lambda hashes: F.forall(hashes, lambda h: h == 0)
    equal = lambda h, s: ((h == F.col("h")) & ~bare("h")) | (s == F.col("sha"))
    return one.select(
        F.col("id").alias(id), "n_chars", F.lower(F.hex("edited_sha")).alias("edited_sha256"),
        _string(F.col("h"), F.lower(F.hex("sha"))).alias("fingerprint"),
        _string(F.col("e"), F.lower(F.hex("edited_sha"))).alias("edited_fingerprint"),
        F.when(equal(F.col("e"), F.col("edited_sha")), 1.0).otherwise(likeness(F.col("h"), F.col("e"))).alias("near_edited"),
        F.when(equal(F.col("next_h"), F.col("next_sha")), 1.0).otherwise(likeness(F.col("h"), F.col("next_h"))).alias("near_next"),
    )
