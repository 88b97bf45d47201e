"""Feedback as pure functions: (dimension, actions) gives the next dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import key_folded, key_lower, strip


def insert_if_absent(local: DataFrame, remote: DataFrame, key: str) -> DataFrame:
    """``local`` and the rows of ``remote`` whose key it lacks; on conflict the local row stays."""
    return local.unionByName(remote.join(local.select(key), key, "left_anti").select(*local.columns))


def upsert(rows: DataFrame, changes: DataFrame, key: str, version: str) -> DataFrame:
    """The latest row of each key, of both tables."""
    both = rows.unionByName(changes)
    picked = both.groupBy(key).agg(F.max_by(F.struct(*(c for c in both.columns if c != key)), version).alias("r"))
    return picked.select(*((F.col(key) if c == key else F.col("r")[c].alias(c)) for c in rows.columns))


def keyed_overrides(rows: DataFrame) -> DataFrame:
    """(key, raw, mapped, version) of overrides (raw, mapped, version) that are not blank."""
    keyed = rows.select(key_lower(F.col("raw")).alias("key"), "raw", strip(F.col("mapped")).alias("mapped"), "version")
    return keyed.where("key <> '' and mapped <> ''")


def upsert_overrides(rows: DataFrame, changes: DataFrame) -> DataFrame:
    """Overrides (raw, mapped, version) after confirmations; blank ones change nothing."""
    return upsert(keyed_overrides(rows), keyed_overrides(changes), "key", "version").select("raw", "mapped", "version")


def keyed_items(actions: DataFrame) -> DataFrame:
    """(key, item): of each action (raw, matched) both texts, one of each key."""
    both = actions.select(F.explode(F.array("raw", F.when(strip(F.col("matched")) != strip(F.col("raw")), F.col("matched")))).alias("item"))
    fresh = both.where("item is not null").select(key_lower(F.col("item")).alias("key"), strip(F.col("item")).alias("item")).where("key <> ''")
    return fresh.groupBy("key").agg(F.min("item").alias("item"))


def append_ignored(items: DataFrame, actions: DataFrame) -> DataFrame:
    """Items (item) and, of each action (raw, matched), both texts whose keys are new."""
    known = items.select(key_lower(F.col("item")).alias("key"))
    return items.select("item").union(keyed_items(actions).join(known, "key", "left_anti").select("item"))


def append_missing(log: DataFrame, records: DataFrame, text: str = "original_text", order: str = "recorded_at") -> DataFrame:
    """``log`` and the records whose text it has not yet, the first of each; blank texts always.

    A record's first is a minimum, which combines before it moves: a text may be a third of all records. Records of
    equal ``order`` are taken by their other columns.
    """
    keyed = records.select(*log.columns).withColumn("__key", key_folded(F.coalesce(F.col(text), F.lit(""))))
    picked = keyed.where("__key <> ''").groupBy("__key").agg(F.min(F.struct(F.col(order).alias("__order"), *log.columns)).alias("__r"))
    known = log.select(key_folded(F.col(text)).alias("__key"))
    fresh = picked.join(known, "__key", "left_anti").select("__r.*").select(*log.columns)
    return log.unionByName(fresh).unionByName(keyed.where("__key = ''").select(*log.columns))


def truncated(log: DataFrame) -> DataFrame:
    """The table's columns without its rows."""
    return log.limit(0)


def invoice_progress(lines: DataFrame, actions: DataFrame) -> DataFrame:
    """(invoice, items, copied, complete) from lines (invoice, pos) and actions (invoice, pos,
    action): complete if all are copied, or if an action without a line says so."""
    copied = actions.where("action = 'copied' and pos is not null").select("invoice", "pos").distinct().withColumn("c", F.lit(1))
    manual = actions.where("action = 'complete' and pos is null").select("invoice").distinct().withColumn("manual", F.lit(True))
    counted = lines.join(copied, ["invoice", "pos"], "left").groupBy("invoice").agg(
        F.count("*").alias("items"), F.coalesce(F.sum("c"), F.lit(0)).cast("long").alias("copied")
    )
    done = (F.col("items") == F.col("copied")) | F.coalesce("manual", F.lit(False))
    return counted.join(manual, "invoice", "left").select("invoice", "items", "copied", done.alias("complete"))
