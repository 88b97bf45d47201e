import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import labelled, quality, toxicity
from tallyloom.llm.common import crc32_mod
from tallyloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_pooled_features_equal_a_plain_convolution():
    rng = np.random.default_rng(1)
    net = quality.Network(rng.normal(size=(quality.WIDTH, 256, quality.FILTERS)).astype(np.float32), np.zeros(quality.FILTERS, np.float32), rng.normal(size=quality.FEATURES), 0.1)
    net.filters[:, 0] = 0
    texts = ["", "a", "hello world " * 60, "é" * 300]
    data, offsets = quality.text_buffers(pa.array(texts))
    got = net.scores(data, offsets)
    for text, score in zip(texts, got):
        raw = np.frombuffer(text.encode(), np.uint8)
        hidden = []
        for begin in range(0, max(1, len(raw) - quality.CHUNK + quality.STRIDE), quality.STRIDE):
            part = np.concatenate([raw[begin : begin + quality.CHUNK + quality.WIDTH - 1], np.zeros(quality.WIDTH, np.uint8)])
            places = range(min(quality.CHUNK, max(1, len(raw) - begin)))
            hidden.append(np.max([sum(net.filters[k][part[p + k] if p + k < len(part) else 0] for k in range(quality.WIDTH)) for p in places], axis=0))
        hidden = np.maximum(np.array(hidden), 0)
        full = min(len(raw), quality.CHUNK) / quality.CHUNK
        z = np.concatenate([hidden.mean(0), hidden.max(0), [full, full**0.5]]) @ net.weights + net.offset
        assert score == pytest.approx(1 / (1 + np.exp(-np.clip(z, -30, 30))), abs=1e-4)


def test_label_model_finds_the_good_voters():
    rng = np.random.default_rng(2)
    truth = rng.random(4000) < 0.2
    votes = np.zeros((4000, 5), np.int8)
    for k, accuracy in enumerate((0.95, 0.9, 0.8, 0.55, 0.9)):
        right = rng.random(4000) < accuracy
        votes[:, k] = np.where(right == truth, 1, -1)
    votes[:, 4] = votes[:, 1]  # a copy of another voter
    model = toxicity.LabelModel.fit(votes)
    accuracy = [(model.table[k, 0, 0] + model.table[k, 1, 2]) / 2 for k in range(5)]
    assert accuracy[0] > accuracy[2] > accuracy[3]
    assert model.own[1] < model.own[0] and model.own[4] < model.own[0]
    assert ((model.posterior(votes) > 0.5) == truth).mean() > 0.93


def test_voters_read_disguises_and_phrases():
    reader = toxicity.Reader()
    (found, _, _), = list(reader(pa.array(["you are an 1d10t", "SHUT UP now", "a clean line", "", None, "Idiot!"])))
    votes = {n: found[:, k] for k, n in enumerate(reader.names)}
    assert votes["disguised"].tolist() == [1, 0, 0, 0, 0, 0]
    assert votes["phrases"].tolist() == [0, 1, 0, 0, 0, 0]
    assert votes["stupidity"].tolist() == [0, 0, 0, 0, 0, 1]


@pytest.mark.parametrize("name, label, modulus, rest, least", [("op2_toxicity", "toxic", 5, 0, 0.9), ("op3_quality", "quality", 4, 2, 0.9)])
def test_held_out_accuracy(spark, name, label, modulus, rest, least):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = QUERIES[name](spark, SF).join(labels, "doc_id").where("held_out").select("score", "predicted", label).toPandas()
    assert len(rows) > 50 and ((rows["score"] >= 0) & (rows["score"] <= 1)).all()
    assert (rows["predicted"] == rows[label]).mean() >= least
    ones, zeros = (rows.loc[rows[label] == v, "score"].to_numpy() for v in (1, 0))
    assert (ones[:, None] > zeros[None, :]).mean() > 0.9  # always answering 0 would give 0


def test_one_of_near_copies_counts_whatever_texts_begin_with():
    rng = random.Random(5)
    words = [f"w{''.join(rng.choices('abcdefgh', k=6))}" for _ in range(400)]
    beginning = " ".join(words[:20])  # over 80 characters
    toxic = [f"{beginning} {' '.join(rng.sample(words[20:], 30))} zzfoe" for _ in range(8)]
    clean = [f"{beginning} {' '.join(rng.sample(words[20:], 30))}" for _ in range(300)]
    copies = [" ".join(words[30:60]) + " onlycopied"] * 50
    labels = np.array([1] * 8 + [0] * 300 + [1] * 50)
    learned = toxicity.learn_words(pa.array(toxic + clean + copies), labels)
    code = lambda w: toxicity._codes([w])[0]
    assert code("zzfoe") in learned and code("onlycopied") not in learned


@pytest.mark.parametrize("module", [toxicity, quality])
def test_odd_rows_and_no_labels(spark, module):
    docs = spark.createDataFrame([(1, "x", "a"), (1, "x", "a"), (2, None, "a"), (3, "", None), (None, "word " * 40_000, "")], "doc_id long, text string, n string")
    none = pa.array([], pa.string())
    model = module.train(none, np.zeros(0, int))
    rows = module.score(docs, model).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows) and rows[0].score == rows[1].score
    assert module.score(docs.where("false"), model).count() == 0


def test_sample_is_bounded_and_learnable_rows_only(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(50)] + [(7, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    found = labelled.sample(docs, labels, "toxic", crc32_mod("doc_id", 5) != 0, 20, 100)
    ids = [int(t.as_py().split()[1]) for t in found["text"] if t.as_py()]  # of two texts of a row the smaller counts
    import zlib

    assert len(found) == 20 and len(ids) >= 19 and all(zlib.crc32(str(i).encode()) % 5 for i in ids)
