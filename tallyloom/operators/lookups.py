"""Dimensions of the equi-joins: which of several rows of a key counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.features import anchor, form_group, numbers, search_key
from ..functions.text import key_lower, key_upper, strip
from .similar import spread


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key: that of the largest ``order``."""
    return _one(rows, key, lambda row: F.max_by(row, order))


def first_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key: that of the smallest ``order``."""
    return _one(rows, key, lambda row: F.min_by(row, order))


def _one(rows: DataFrame, key: str, pick) -> DataFrame:
    found = rows.where(F.col(key).isNotNull()).groupBy(key).agg(pick(F.struct(*(c for c in rows.columns if c != key))).alias("__row"))
    return found.select(key, *(F.col("__row")[c].alias(c) for c in rows.columns if c != key))


def catalog_features(catalog: DataFrame) -> DataFrame:
    """``catalog`` (idx, code, name, price) with what matching compares, found once for a distinct name and over all cores: a
    large catalog may lie in one small file."""
    names = spread(catalog.select(F.col("name").alias("__name")).distinct()).withColumn("search_key", search_key(F.col("__name"))).select(
        "__name", "search_key", numbers(F.col("__name")).alias("numbers"), form_group(F.col("__name")).alias("form"), anchor(F.col("search_key")).alias("anchor"),
    )
    found = spread(catalog).join(names, F.col("name").eqNullSafe(F.col("__name")))
    return found.select("idx", "code", "name", "price", "search_key", "numbers", "form", "anchor")


def overrides(rows: DataFrame) -> DataFrame:
    """(key, mapped) of (raw, mapped, version): blank names do not count, the last wins."""
    keyed = rows.select(key_lower(F.col("raw")).alias("key"), strip(F.col("mapped")).alias("mapped"), "version")
    return last_wins(keyed.where("key <> ''"), "key", "version").where("mapped <> ''").select("key", "mapped")


def reference_map(rows: DataFrame) -> DataFrame:
    """(key, code) of (english, code, version): blank keys and null codes do not count, the last wins."""
    keyed = rows.select(key_upper(F.col("english")).alias("key"), strip(F.col("code").cast("string")).alias("code"), "version")
    return last_wins(keyed.where("key <> '' and code is not null"), "key", "version").select("key", "code")


def by_code(catalog: DataFrame) -> DataFrame:
    """The catalog row of each code, the last of equal ones."""
    return last_wins(catalog.withColumn("code_key", strip(F.col("code").cast("string"))), "code_key", "idx")


def by_name(catalog: DataFrame) -> DataFrame:
    return first_wins(catalog, "name", "idx")


def by_search_key(catalog: DataFrame) -> DataFrame:
    return first_wins(catalog.where("search_key <> ''"), "search_key", "idx")


def guards(numbers_a: Column, numbers_b: Column, form_a: Column, form_b: Column, anchor_a: Column, anchor_b: Column, cutoff: float) -> Column:
    """Whether a query (a) and a row (b) may be one product: its numbers are the row's, forms do
    not differ where both are known, and the longest core words are alike."""
    from ..functions.similarity import ratio

    same_numbers = F.size(F.array_except(numbers_a, numbers_b)) == 0
    same_form = F.coalesce(form_a == form_b, F.lit(True))
    alike = F.coalesce(F.when(anchor_a == anchor_b, True).otherwise(ratio(anchor_a, anchor_b) >= cutoff), F.lit(True))
    return same_numbers & same_form & alike
