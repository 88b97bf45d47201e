"""Feedback saved: each action changes a table in versions (``sources.versions``), reading and writing touched buckets only.

Overrides are (key, raw, mapped, version), ignored items (key, item), and the log of missing texts has a ``key`` beside
its own columns, in a table made with ``spread``: records without a text are never the same.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import key_folded
from ..sources import versions
from . import merges


def save_overrides(changes: DataFrame, path: str) -> versions.Version:
    """Confirmations (raw, mapped, version): the latest of each key stays; blank ones change nothing."""
    return versions.change(merges.keyed_overrides(changes), path, partial(merges.upsert, key="key", version="version"))


def save_ignored(actions: DataFrame, path: str) -> versions.Version:
    """Actions (raw, matched): both texts, where their keys are new."""
    return versions.change(merges.keyed_items(actions), path, partial(merges.insert_if_absent, key="key"))


def log_missing(records: DataFrame, path: str, applied: tuple[str, int] | None = None) -> versions.Version:
    """Records of the log's columns: the first of each text that the log has not; those without a text always."""
    keyed = records.withColumn("key", key_folded(F.coalesce("original_text", F.lit(""))))
    return versions.change(keyed, path, merges.append_missing, applied)


def new_log(records: DataFrame, path: str, buckets: int = 64) -> versions.Version:
    """A log in versions, of the records of an older one."""
    return versions.create(records.withColumn("key", key_folded(F.coalesce("original_text", F.lit("")))), path, "key", buckets, spread=True)
