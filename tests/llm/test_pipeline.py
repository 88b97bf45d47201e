import pytest

import corpus_pipeline
from tallyloom.llm import sentencepieces
from tallyloom.llm.common import stage
from tallyloom.llm.queries import PIECES

SF = "/root/testdata/sf0.001"


def test_every_stage_works_on_what_the_one_before_kept(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {r.doc_id for r in docs.collect()}
    for name, function in corpus_pipeline.STAGES:
        out = stage(function(spark, docs, SF), "out")
        ids = [r.doc_id for r in out.select("doc_id").collect()]
        assert set(ids) <= kept and len(ids) == len(set(ids)) and ids, name
        if name != "sentencepiece":
            assert out.columns == columns, name
            docs, kept = out, set(ids)
    texts = {r.doc_id: r.text for r in docs.collect()}
    codec = sentencepieces.codec(PIECES)
    rows = out.collect()
    assert {r.doc_id for r in rows} == kept
    assert all(codec.decode(r.ids) == texts[r.doc_id] and r.round_trip for r in rows)


def test_odd_rows_pass_through(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    rows = [(1, None, None, None, None), (None, "", "en", "src1", 0), (2, "x", "en", None, 1), (2, "x", "en", None, 1)]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for name, function in corpus_pipeline.STAGES[1:]:
            assert function(spark, docs, SF).count() <= docs.count(), name
