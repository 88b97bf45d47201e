"""Fuzzy semi-joins: ignored and controlled products, and parties of an invoice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import MatchConfig
from ..functions.features import core_tokens
from ..functions.text import key_lower, strip
from ..staging import outlive, stage, staging
from .similar import at_least, top_k


def _numbered(values: DataFrame, column: str) -> DataFrame:
    return values.select(F.col(column).alias("key")).distinct().select(F.xxhash64("key").alias("id"), "key")


def ignored(texts: DataFrame, items: DataFrame, config: MatchConfig = MatchConfig()) -> DataFrame:
    """The distinct texts (column text) that equal an item (column item) as keys or come near one. Staged."""
    with staging(texts.sparkSession):
        keyed = texts.where("text is not null").distinct().select("text", key_lower(F.col("text")).alias("key")).where("key <> ''")
        keys = stage(items.select(key_lower(F.col("item")).alias("key")).where("key <> ''").distinct(), "items")
        equal = keys.select(F.col("key").alias("same"))
        keyed = stage(keyed.join(equal, F.col("key") == F.col("same"), "left"), "keyed")
        rest = keyed.where("same is null")
        near = at_least(rest.select(F.col("key").alias("text")), _numbered(keys, "key"), config.ignored_ratio)
        near = near.select(F.col("text").alias("key")).distinct()
        hits = keyed.where("same is not null").select("text").union(rest.join(near, "key", "left_semi").select("text"))
        return outlive(stage(hits, "ignored"))


def controlled_entries(rows: DataFrame, heading: str = "اسم الصنف", title: tuple[str, str] = ("جدول", "مهم")) -> DataFrame:
    """(entry, words) of (name): headings and titles are left out."""
    name = strip(F.col("name"))
    named = rows.select(name.alias("entry")).where((F.col("entry") != "") & (F.col("entry") != heading))
    named = named.where(~(F.contains("entry", F.lit(title[0])) & F.contains("entry", F.lit(title[1]))))
    return named.distinct().select("entry", F.array_distinct(core_tokens(F.col("entry"))).alias("words"))


def controlled(texts: DataFrame, entries: DataFrame, config: MatchConfig = MatchConfig()) -> DataFrame:
    """The distinct texts (column text) that have, for every word of some entry, a word like it.

    Words are compared once, as a dictionary. A text meets an entry only through the entry's rarest word, the one
    with a like word in the fewest texts, and is then asked for the entry's other words; so a word that many
    texts and entries share brings no pairs of them together, unless an entry has no rarer one.
    """
    items = texts.where("text is not null and text <> ''").distinct()
    with staging(texts.sparkSession):
        words = stage(items.select("text", F.explode(F.array_distinct(core_tokens(F.col("text")))).alias("word")), "words")
        listed = stage(entries.where(F.size("words") > 0).select("entry", F.size("words").alias("n"), F.explode("words").alias("listed")), "listed")
        keys = _numbered(listed, "listed")
        alike = at_least(words.select(F.col("word").alias("text")), keys, config.controlled_ratio)
        alike = alike.join(keys, "id").select(F.col("text").alias("word"), F.col("key").alias("listed"))
        has = stage(words.join(alike, "word").select("text", "listed").distinct(), "has")
        seen = has.groupBy("listed").agg(F.count("*").alias("texts"))
        probe = listed.join(seen, "listed", "left").groupBy("entry", "n").agg(  # null for a word that no text has: no text meets the entry
            F.min_by("listed", F.struct(F.coalesce("texts", F.lit(0)), "listed")).alias("listed")
        )
        met = has.join(probe, "listed").select("text", "entry", "n")
        every = met.join(listed.select("entry", "listed"), "entry").join(has, ["text", "listed"], "left_semi")
        full = every.groupBy("text", "entry", "n").agg(F.count("*").alias("met")).where("met = n")
        return outlive(stage(full.select("text").distinct(), "controlled"))


# What a code in a header looks like, and how far after "to:" it may stand.
CODE = r"[A-Za-z][A-Za-z0-9\-]*(?:/[A-Za-z0-9\-]+){1,2}"
REACH = 250


def _runs(text, pattern: str):
    """Every run of a pattern in a text."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def resolve_party(headers: DataFrame, directory: DataFrame, config: MatchConfig = MatchConfig()) -> DataFrame:
    """(header, party, matched, tier) of each distinct header.

    Tiers: a full code within the header, the longest first; a first segment that only one
    party has, as a word; the code after ``to:`` that is nearest; the bare code, unmatched.
    ``directory`` has pos, code, name.

    A code is found by equi-joins and never by asking each header for each code: by a slice of the header at the
    code's length where the code's first few characters are (a code may stand within a longer run), and a first segment
    by the words that the header is cut into.
    """
    texts = headers.select("header").distinct()
    with staging(headers.sparkSession):
        told = stage(texts.where(strip(F.coalesce("header", F.lit(""))) != "").withColumn("low", F.lower("header")), "headers")
        codes = directory.select("pos", "name", F.col("code"), key_lower(F.col("code")).alias("full"))
        codes = stage(codes.where("full <> ''").withColumn("short", F.substring_index("full", "/", 1)), "codes")

        # Every place of a header, by the characters that a code there begins with; then the whole code.
        head = codes.agg(F.min(F.length("full"))).first()[0] or 1
        head = min(head, 8)
        lengths = codes.select(F.substring("full", 1, head).alias("begin"), F.length("full").alias("n")).groupBy("begin").agg(F.collect_set("n").alias("ns"))
        starts = F.sequence(F.lit(1), F.greatest(F.length("low") - head + 1, F.lit(1)))
        places = told.select("header", "low", F.explode(starts).alias("at")).withColumn("begin", F.substring("low", F.col("at"), F.lit(head)))
        slices = places.join(lengths, "begin").select("header", "low", "at", F.explode("ns").alias("n"))
        slices = slices.select("header", F.substring("low", F.col("at"), F.col("n")).alias("full")).distinct()
        first = slices.join(codes, "full").groupBy("header").agg(F.min_by("name", F.struct(-F.length("code"), "pos")).alias("name")).withColumn("tier", F.lit(1))

        alone = codes.groupBy("short").agg(F.count_distinct("name").alias("n"), F.min_by("name", "pos").alias("name"), F.min("pos").alias("pos")).where("n = 1")
        alone = stage(alone.select("short", "name", "pos"), "alone")
        plain = alone.where(~F.col("short").rlike("[^a-z0-9]"))
        words = told.select("header", F.explode(F.array_distinct(_runs(F.col("low"), "[a-z0-9]+"))).alias("short"))
        second = words.join(plain, "short")
        # First segments with other characters span several words: they are looked for where their first word is.
        odd = alone.where(F.col("short").rlike("[^a-z0-9]")).withColumn("word", F.regexp_extract("short", "[a-z0-9]+", 0))
        within = F.expr(r"low rlike concat('(?<![a-z0-9])\\Q', replace(short, '\\E', ''), '\\E(?![a-z0-9])')")
        spanning = words.select("header", F.col("short").alias("word")).join(odd.where("word <> ''"), "word").join(told, "header").where(within)
        second = second.select("header", "name", "pos").union(spanning.select("header", "name", "pos"))
        second = second.groupBy("header").agg(F.min_by("name", "pos").alias("name")).withColumn("tier", F.lit(2))

        at = F.instr("low", "to:")
        region = F.when(at > 0, F.substring("header", at, F.lit(REACH))).otherwise(F.col("header"))
        found = stage(told.select("header", F.regexp_extract(region, CODE, 0).alias("token")), "tokens")
        # Only headers without a hit of the first tiers ask for near codes, and only codes that are near enough count.
        hits = stage(first.select("header", "name", "tier").union(second.select("header", "name", "tier")), "hits")
        rest = found.where("token <> ''").join(hits, "header", "left_anti")
        near = top_k(rest.select(F.col("token").alias("text")), codes.select(F.col("pos").alias("id"), F.col("code").alias("key")), 1, config.party_ratio)
        near = near.where(F.col("score") >= config.party_ratio).join(codes.select(F.col("pos").alias("id"), "full"), "id")
        of_code = codes.groupBy("full").agg(F.max_by("name", "pos").alias("name"))
        near = near.join(of_code, "full").select(F.col("text").alias("token"), "name")
        third = rest.join(near, "token").select("header", "name", F.lit(3).alias("tier"))

        hits = hits.union(third)
        best = hits.groupBy("header").agg(F.min_by("name", "tier").alias("name"), F.min("tier").alias("tier"))
        out = texts.join(best, "header", "left").join(found, "header", "left")
        out = out.select(
            "header", F.coalesce("name", "token", F.lit("")).alias("party"), F.col("name").isNotNull().alias("matched"), F.coalesce("tier", F.lit(4)).alias("tier")
        )
        return outlive(stage(out, "parties"))
