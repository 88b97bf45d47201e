"""The corpus pipeline: each stage works on all that the one before it kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame. All but the last return the columns of ``documents``. Null and empty texts, repeated
rows and empty tables pass through as each operator states.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import lines, mixing, near_dedup, quality, sentencepieces
from tallyloom.llm.common import outlive, stage, staging, table, unstage
from tallyloom.llm.queries import MIX, PIECES, domain, quality_network

# Once through the corpus at most, nine tenths of its tokens: no document is repeated.
PIPELINE_MIX = replace(MIX, max_epochs=1)
PIPELINE_SHARE = 0.9


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality network rejects (score under 0.7) go."""
    network = quality_network(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality.score(docs, network, score="__score").where("__score >= 0.7").select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-equal lines the first stays; documents without a line left go."""
    return lines.drop_repeats(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return near_dedup.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source gives a token-prefix of its seeded order, by the weights of the mix."""
    return mixing.select(domain(docs), PIPELINE_MIX, share=PIPELINE_SHARE, repeat=True).select(*docs.columns)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether they decode to its text."""
    out = sentencepieces.encode(docs, PIECES, verify="round_trip", keep=["doc_id", "lang", "source"])
    return out.select("doc_id", "lang", "source", F.size("ids").alias("n_tokens"), "round_trip", "ids")


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("sentencepiece", encoding_stage),
]

# Trained scores, MinHash components and Viterbi ids are beyond SQL; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; a stage's input goes once its output is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, function in STAGES[:-1]:
        with staging(spark):
            docs = outlive(stage(function(spark, docs, sf_dir), name))
        if before is not None:
            unstage(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
