"""The matching cascade: override, reference map, exact name, exact key, fuzzy, rejected.

Tiers run over distinct texts, each over what the one before left; scores are computed once
for a distinct candidate, and so is all of the decision that no price changes. A line meets what was
decided for its text, and its price is only compared with the prices of the candidates that qualify.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import MatchConfig
from ..functions.features import anchor, form_group, numbers, search_key, variants
from ..functions.lexicon import candidate
from ..functions.text import clean_line, is_arabic, key_lower, key_upper, strip
from ..operators import decide, lookups, semijoins, similar
from ..staging import stage


@dataclass
class Dimensions:
    """catalog: idx, code, name, price. overrides: raw, mapped, version. reference_map:
    english, code, version. ignored: item. controlled: name. Only the catalog is needed."""

    catalog: DataFrame
    overrides: DataFrame | None = None
    reference_map: DataFrame | None = None
    ignored: DataFrame | None = None
    controlled: DataFrame | None = None


def candidates(texts: DataFrame) -> DataFrame:
    """(text, core_text, candidate) of texts (text)."""
    cleaned = similar.spread(texts).withColumn("c", clean_line(F.col("text")))
    core = F.col("c.core_text")
    return cleaned.select("text", core.alias("core_text"), candidate(core, F.col("c.extracted_units_ar"), is_arabic(core)).alias("candidate"))


def rank(queries: DataFrame, features: DataFrame, config: MatchConfig = MatchConfig()) -> DataFrame:
    """(candidate, ranked) of distinct queries (candidate): the best rows of any spelling, sorted by
    score and then idx: array<struct(order, idx, score, name, code, price, ok)>."""
    spelled = queries.select("candidate", F.explode(variants(F.col("candidate"))).alias("text"))
    top = similar.top_k(spelled.select("text"), features.select(F.col("idx").alias("id"), F.col("search_key").alias("key")), config.candidates)
    best = stage(spelled.join(top, "text").groupBy("candidate", "id").agg(F.max("score").alias("score")), "scored")
    asked = queries.select(
        "candidate", numbers(F.col("candidate")).alias("q_numbers"), form_group(F.col("candidate")).alias("q_form"), anchor(F.col("candidate")).alias("q_anchor")
    )
    rows = best.join(features, F.col("id") == F.col("idx")).join(asked, "candidate")
    ok = lookups.guards(F.col("q_numbers"), F.col("numbers"), F.col("q_form"), F.col("form"), F.col("q_anchor"), F.col("anchor"), config.anchor_ratio)
    row = F.struct((-F.col("score")).alias("order"), "idx", "score", "name", "code", "price", "ok")
    return rows.withColumn("ok", ok).groupBy("candidate").agg(F.array_sort(F.collect_list(row)).alias("ranked"))  # 72 rows at most


def decided(ranked: DataFrame, config: MatchConfig = MatchConfig()) -> DataFrame:
    """(candidate, fit, closest, best): what no price changes of the decision on ranked rows (candidate, ranked)."""
    fit = F.transform(decide.qualified(F.col("ranked"), config), lambda c: F.struct(c["score"].alias("score"), c["name"].alias("name"), c["code"].alias("code"), c["price"].alias("price"), c["ok"].alias("ok")))
    closest = decide.closest(F.col("ranked"))
    closest = F.when(closest.isNotNull(), F.struct(closest["name"].alias("name"), closest["code"].alias("code"), closest["price"].alias("price")))
    return ranked.select("candidate", fit.alias("fit"), closest.alias("closest"), F.get("ranked", 0)["score"].alias("best"))


def match(lines: DataFrame, dims: Dimensions, config: MatchConfig = MatchConfig()) -> DataFrame:
    """``lines`` (text, invoice_price, quantity and any others) with the result columns."""
    features = stage(lookups.catalog_features(dims.catalog), "catalog")
    keep = [c for c in lines.columns if c not in ("text", "invoice_price", "quantity")]
    texts = lines.select(strip(F.coalesce("text", F.lit(""))).alias("text")).distinct()
    blank = F.lit(None).cast("string")

    found = texts.withColumn("override", blank)
    if dims.overrides is not None:
        keyed = lookups.overrides(dims.overrides).withColumnRenamed("mapped", "override")
        found = texts.join(keyed, key_lower(F.col("text")) == F.col("key"), "left").drop("key")
    if dims.reference_map is not None:
        mapped = lookups.reference_map(dims.reference_map).join(
            lookups.by_code(features).select(F.col("code_key").alias("code"), F.struct("name", F.col("code_key").alias("code"), "price").alias("mapped")), "code"
        ).select("key", "mapped")
        open_ = found.where("override is null").join(mapped, key_upper(F.col("text")) == F.col("key"), "left").drop("key")
        found = open_.unionByName(found.where("override is not null"), allowMissingColumns=True)
    else:
        found = found.withColumn("mapped", F.lit(None).cast("struct<name:string,code:string,price:double>"))

    found = stage(found, "resolved")
    rest = stage(candidates(found.where("override is null and mapped is null and text <> ''").select("text")), "candidates")
    asked = rest.select("candidate").where("candidate <> ''").distinct()
    pick = F.struct("name", "code", "price")
    named = lookups.by_name(features).select(F.col("name").alias("k"), pick.alias("by_name"))
    keyed = lookups.by_search_key(features).select(F.col("search_key").alias("k"), pick.alias("by_key"))
    exact = asked.join(named, F.col("candidate") == F.col("k"), "left").drop("k")
    exact = exact.join(keyed, search_key(F.col("candidate")) == F.col("k"), "left").drop("k")
    exact = stage(exact.select("candidate", F.coalesce("by_name", "by_key").alias("exact")), "exact")
    ranked = rank(exact.where("exact is null").select("candidate"), features, config)
    scored = exact.join(decided(ranked, config), "candidate", "left")

    texts = flagged(stage(found.join(rest, "text", "left").join(scored, "candidate", "left"), "decided"), dims, config)
    joined = lines.withColumn("__text", strip(F.coalesce("text", F.lit("")))).join(texts.withColumnRenamed("text", "__t"), F.col("__text") == F.col("__t"))
    joined = joined.withColumn("chosen", decide.of_price(F.col("fit"), F.col("invoice_price"), config))
    verified = decide.price_matches(F.col("chosen.price"), F.col("invoice_price"), config)
    kind = (
        F.when(F.col("override").isNotNull(), "exception").when(F.col("mapped").isNotNull(), "reference_map")
        .when(F.col("exact").isNotNull() | F.coalesce("chosen.ok", F.lit(False)), "database")
        .when(F.col("closest").isNotNull(), "database_low_confidence").otherwise("unmatched")
    )
    source, auto = F.col("source"), F.col("source") == "database"
    joined = joined.withColumn("source", kind)
    rejected = F.coalesce("chosen.score", "best", F.lit(0.0))
    score = (
        F.when(source == "exception", 100.0).when(source == "reference_map", config.automatic_cap)
        .when(auto & F.col("exact").isNotNull(), decide.cap(F.lit(100.0), config))
        .when(auto, decide.cap(decide.with_bonus(F.col("chosen.score"), verified, config), config)).otherwise(rejected)
    )
    row = F.coalesce(F.when(source == "reference_map", F.col("mapped")), F.when(auto, F.coalesce("exact", F.struct("chosen.name", "chosen.code", "chosen.price"))), F.struct("closest.name", "closest.code", "closest.price"))
    joined = joined.withColumn("score", score).withColumn("row", F.when(source != "exception", row))
    accepted = source.isin("exception", "reference_map", "database")
    suggested = F.when(source == "exception", F.col("override")).otherwise(F.coalesce("row.name", F.lit("")))
    joined = joined.withColumn("suggested_arabic", suggested)
    hit = lambda hits, own: F.coalesce(F.array_contains(hits, F.col(own)) | F.array_contains(hits, F.col("suggested_arabic")), F.lit(False))
    return joined.select(
        *keep, F.col("text").alias("original_text"),
        "suggested_arabic", "score", F.when(accepted, decide.confidence_color(F.col("score"), config)).otherwise("red").alias("color"), "source",
        F.col("row.code").alias("matched_code"), F.col("row.price").cast("string").alias("matched_price"), "invoice_price", "quantity",
        ((source == "reference_map") | (auto & F.col("exact").isNull() & verified)).alias("price_verified"),
        (~accepted & F.col("chosen").isNotNull()).alias("rejected_by_guard"),
        F.coalesce("core_text", F.lit("")).alias("debug_core_text"), F.coalesce("candidate", F.lit("")).alias("debug_transliterated"),
        (hit("ignore_hits", "__text") if dims.ignored is not None else F.lit(False)).alias("ignored"),
        (hit("control_hits", "candidate") if dims.controlled is not None else F.lit(False)).alias("controlled"),
    )


def flagged(texts: DataFrame, dims: Dimensions, config: MatchConfig = MatchConfig()) -> DataFrame:
    """``texts`` (a staged table of what is known of each distinct text) with ``ignore_hits`` and ``control_hits``: which of the text,
    or its candidate, and the names that a line of it could be given are ignored or controlled. So no line is asked, whatever their number."""
    fits = F.transform(F.filter("fit", lambda c: c["ok"]), lambda c: c["name"])
    names = F.concat(F.array("override", "mapped.name", "exact.name", "closest.name"), F.coalesce(fits, F.array().cast("array<string>")))

    def marked(own: str, search, to: str) -> DataFrame:
        asked = stage(texts.select("text", F.explode(F.array_distinct(F.concat(F.array(own), names))).alias("name")).where("name <> ''"), "asked")
        hits = search(asked.select(F.col("name").alias("text")).distinct()).select(F.col("text").alias("name")).distinct()
        return asked.join(hits, "name").groupBy("text").agg(F.collect_set("name").alias(to))  # 74 names at most

    out = texts
    if dims.ignored is not None:
        out = out.join(marked("text", lambda asked: semijoins.ignored(asked, dims.ignored, config), "ignore_hits"), "text", "left")
    if dims.controlled is not None:
        entries = semijoins.controlled_entries(dims.controlled)
        out = out.join(marked("candidate", lambda asked: semijoins.controlled(asked, entries, config), "control_hits"), "text", "left")
    return out


def rematch(edits: DataFrame, catalog: DataFrame, config: MatchConfig = MatchConfig()) -> DataFrame:
    """``edits`` (text and any others) with ``name``: the catalog's, if the text as typed is
    accepted without a price, or else the text, white space collapsed."""
    from ..functions.text import collapse

    typed = edits.withColumn("candidate", collapse(F.col("text")))
    features = stage(lookups.catalog_features(catalog), "catalog")
    asked = typed.select("candidate").where("candidate <> ''").distinct()
    named = lookups.by_name(features).select(F.col("name").alias("candidate"), F.col("name").alias("by_name"))
    keyed = lookups.by_search_key(features).select(F.col("search_key").alias("k"), F.col("name").alias("by_key"))
    exact = asked.join(named, "candidate", "left").join(keyed, search_key(F.col("candidate")) == F.col("k"), "left")
    exact = exact.select("candidate", F.coalesce("by_name", "by_key").alias("exact"))
    ranked = rank(exact.where("exact is null").select("candidate"), features, config)
    chosen = decide.choose(F.col("ranked"), F.lit(None).cast("double"), config)
    found = exact.join(ranked, "candidate", "left").withColumn("chosen", chosen)
    found = found.select("candidate", F.coalesce("exact", F.when(F.col("chosen.ok"), F.col("chosen.name"))).alias("hit"))
    return typed.join(found, "candidate", "left").withColumn("name", F.coalesce("hit", "candidate")).drop("candidate", "hit")
