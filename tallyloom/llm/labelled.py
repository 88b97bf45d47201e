"""Bounded samples of labelled documents for the classifiers that are trained here."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sample(docs: DataFrame, labels: DataFrame, label: str, learnable: Column, max_rows: int, max_chars: int) -> pa.Table:
    """At most ``max_rows`` labelled rows (text, label) with ``learnable`` true, by the order of a hash of the id.

    Texts over ``max_chars`` are left out of the sample, not cut. The ids are chosen from the
    label table alone, so the join broadcasts ``max_rows`` rows at most. Rows with a null
    label do not count; of several labels of a row the largest does.
    """
    chosen = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & learnable)
        .groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    )
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.length("text") <= max_chars)
    found = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
    return found.orderBy(F.xxhash64("doc_id"), "doc_id").select("text", "label").limit(max_rows).toArrow()
