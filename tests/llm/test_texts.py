import hashlib
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import imatch, packing, sentencepieces
from tallyloom.llm.queries import PIECES, QUERIES


@pytest.fixture(scope="module")
def codec():
    return sentencepieces.codec(PIECES)


TEXTS = ["", " ", "Hello  world\n\nx ▁ y", "▁", "  lead and trail  ", "naïve — 漢字 😀 \x00 tab\t", "a" * 300, "\n", "ordinary words of a line"]


def test_round_trip(codec):
    rng = random.Random(1)
    more = ["".join(rng.choices("ab ▁\né漢😀the", k=rng.randint(0, 40))) for _ in range(300)]
    for text in TEXTS + more:
        assert codec.decode(codec.encode(text)) == text


def test_path_is_the_best_of_all(codec):
    pieces, kind = sentencepieces.read_model(PIECES)
    scores = {p[0]: s for p, s in zip(pieces, sentencepieces.log_probabilities(pieces, kind)) if p[2] == sentencepieces.NORMAL}
    for run in ("▁the", "▁word", "▁ener", "ing", "▁x漢y", "▁▁a"):
        best = -math.inf
        for cuts in itertools.product([0, 1], repeat=len(run) - 1):
            parts, at = [], 0
            for i, c in enumerate(cuts, 1):
                if c:
                    parts.append(run[at:i])
                    at = i
            parts.append(run[at:])
            total = 0.0
            for p in parts:
                total += scores.get(p, codec.unknown if len(p) == 1 else -math.inf)
            best = max(best, total)
        ids, total, chars = codec.viterbi(run), 0.0, 0
        byte_runs = 0
        for i in ids:
            if pieces[i][2] == sentencepieces.BYTE:
                byte_runs += 1
            else:
                total += scores[pieces[i][0]]
        if byte_runs:
            total += codec.unknown * (byte_runs // 3)
        assert total == pytest.approx(best)


def test_runs_alone_give_what_the_whole_text_gives(codec):
    for text in ("the words  of a line", " two\nlines here "):
        whole = codec.viterbi((" " + text).replace(" ", sentencepieces.SPACE))
        assert codec.encode(text) == whole


def test_encode_frame(spark):
    docs = spark.createDataFrame([(1, "a b", "k"), (1, "a b", "k"), (2, None, "k"), (3, "", None)], "doc_id long, text string, ids0 string")
    rows = sentencepieces.decode(sentencepieces.encode(docs, PIECES, verify="ok"), PIECES).collect()
    assert [(r.text, r.decoded, r.ok) for r in rows] == [("a b", "a b", True), ("a b", "a b", True), (None, None, None), ("", "", True)]
    assert sentencepieces.encode(docs.where("false"), PIECES).count() == 0


def plain_best_fit(lengths, size):
    rows = []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        room = [(size - sum(lengths[j] for j in r), k) for k, r in enumerate(rows)]
        fit = [x for x in room if x[0] >= lengths[i]]
        rows[min(fit)[1]].append(i) if fit else rows.append([i])
    return rows


def test_best_fit_equals_a_plain_search():
    rng = np.random.default_rng(0)
    for size in (1, 7, 19, 64):
        for _ in range(30):
            lengths = rng.integers(1, size + 1, 40)
            got = packing.best_fit_decreasing(lengths, size)
            assert sorted(sum(got, [])) == list(range(40)) and all(lengths[r].sum() <= size for r in got)
            assert len(got) == len(plain_best_fit(lengths, size))


@pytest.mark.parametrize("size", [16, 64])
def test_packing_is_lossless(spark, size):
    texts = [(1, "short"), (2, "x" * 200), (3, ""), (4, None), (5, "é" * 50), (5, "é" * 50), (None, "null id")]
    docs = spark.createDataFrame(texts, "id long, text string").withColumnRenamed("id", "doc_id")
    packed = packing.pack(docs, size)
    for r in packed.collect():
        ids = np.frombuffer(r.ids, "<u2")
        assert len(ids) == size and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens and not ids[r.n_tokens :].any()
        assert r.position_resets == r.cu_seqlens[:-1]
        positions = packing.position_ids(r.n_tokens, r.position_resets)
        assert all(positions[a] == 0 for a in r.position_resets) and (np.diff(positions)[np.diff(positions) != 1] <= 0).all()
    back = {}
    for r in packing.unpack(packed, size).collect():
        back.setdefault(r.doc_id, []).append((r.token_start, r.ids))
    for id, text in texts:
        want = [b + 2 for b in (text or "").encode()] + [1]
        parts = sorted(back[id])
        if id == 5:
            assert sum(len(p) for _, p in parts) == 2 * len(want)
        else:
            assert sum((p for _, p in parts), []) == want
    assert packing.pack(docs.where("false"), size).count() == 0


def test_packing_given_ids(spark):
    docs = spark.createDataFrame([(1, [70000, 5]), (2, None)], "doc_id long, ids array<int>")
    rows = packing.unpack(packing.pack(docs, 8, ids="ids"), 8, wide=True).collect()
    assert {r.doc_id: r.ids for r in rows} == {1: [70000, 5, 1], 2: [1]}


def edited(texts, i):
    ids = sorted(texts, reverse=True)
    following = texts[ids[(ids.index(i) + 1) % len(ids)]]
    m = len(texts[i]) // 3
    return texts[i][: len(texts[i]) - m] + following[:m]


def test_fingerprints(spark):
    rng = random.Random(4)
    vocabulary = [f"term{i}" for i in range(300)]
    texts = {7 * i - 50: " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 60, 200]))) for i in range(60)}
    texts |= {9000: texts[-50], 9001: "", 9002: "漢😀é" * 5}
    docs = spark.createDataFrame([(i, t, 1) for i, t in texts.items()], "doc_id long, text string, n long")
    rows = {r.doc_id: r for r in imatch.fingerprints(docs, high=0.3).collect()}
    assert set(rows) == set(texts)
    for i, t in texts.items():
        assert rows[i].n_chars == len(t) and rows[i].edited_sha256 == hashlib.sha256(edited(texts, i).encode()).hexdigest()
        assert 0 <= rows[i].near_edited <= 1 and 0 <= rows[i].near_next <= 1
    assert rows[9000].fingerprint == rows[-50].fingerprint
    long = [r for r in rows.values() if r.n_chars > 800]
    assert np.mean([r.near_edited for r in long]) > np.mean([r.near_next for r in long]) + 0.2


def test_fingerprints_of_odd_tables(spark):
    docs = spark.createDataFrame([(1, None), (None, "x"), (None, "y z"), (1, None)], "doc_id long, text string")
    rows = imatch.fingerprints(docs).collect()
    assert sorted((r.n_chars for r in rows)) == [0, 0, 1, 3]
    assert imatch.fingerprints(docs.where("false")).count() == 0
    one = imatch.fingerprints(docs.where("text = 'x'")).first()
    assert one.near_next == 1.0 and one.near_edited == 1.0


def test_fingerprints_of_a_group_of_near_copies_above_the_band(spark):
    rng = random.Random(6)
    vocabulary = [f"term{i}" for i in range(4000)]
    base = rng.choices(vocabulary[:3000], k=150)
    texts = {}
    for i in range(150):
        words = list(base) if i % 3 == 0 else rng.choices(vocabulary, k=150)
        for _ in range(4 if i % 3 == 0 else 0):
            words[rng.randrange(150)] = rng.choice(vocabulary)
        texts[i // 3 if i % 3 == 0 else 1000 + i] = " ".join(words)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = {r.doc_id: r for r in imatch.fingerprints(docs).collect()}
    group = [rows[i] for i in range(1, 50)]
    assert np.mean([r.near_edited for r in group]) > 0.5
    assert np.mean([r.near_next for r in group]) > 0.4
    assert not any(r.fingerprint.startswith("text:") for r in group)
    assert np.mean([r.near_next for i, r in rows.items() if i > 1001]) < 0.1


def test_fingerprints_do_not_depend_on_ranges(spark, monkeypatch):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    rows = [(rng.choice([i, i, -i, None]), rng.choice([" ".join(rng.choices(words, k=rng.randint(0, 40))), "same text", None])) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    shown = lambda: sorted(map(repr, imatch.fingerprints(docs, high=0.5).collect()))
    want = shown()
    monkeypatch.setattr(imatch, "RANGE_BYTES", 4)  # more ranges than the least
    monkeypatch.setattr(imatch, "LEAST_LEVEL", 2)
    assert imatch._level(docs) > 16 and shown() == want
    monkeypatch.setattr(imatch, "MAX_BROADCAST", 0)
    assert shown() == want
