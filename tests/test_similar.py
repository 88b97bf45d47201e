import random

import numpy as np
import pytest

from tallyloom.functions.similarity import indel
from tallyloom.operators import similar


def plain(texts, keys, k):
    order = lambda x: " ".join(sorted(x.split()))
    out = set()
    for t in {t for t in texts if t is not None}:
        best = sorted((-indel(order(t), order(key)), id) for id, key in keys if key is not None)[:k]
        out |= {(t, id, round(-score, 9)) for score, id in best}
    return out


def rows(frame):
    return {(r.text, r.id, round(r.score, 9)) for r in frame.collect()}


@pytest.fixture
def narrow(monkeypatch):
    """Small blocks, few keys first and two texts of a block in a task, so that every way is taken."""
    for name, value in (("LEAST_BLOCK", 4), ("FIRST", 6), ("SHARE", 2), ("PIVOTS", 9)):
        monkeypatch.setattr(similar, name, value)


def corpus(rng, n):
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(25)] + ["شراب", "أقراص", "12", "7"]
    return [" ".join(rng.choice(words) for _ in range(rng.randint(1, 5))) for _ in range(n)]


def test_the_k_best_equal_a_scan(spark, narrow):
    rng = random.Random(3)
    keys = list(enumerate(corpus(rng, 150))) + [(500 + i, "same key") for i in range(40)] + [(900, None), (901, ""), (902, "x" * 700), (903, "b a"), (904, "a b")]
    texts = [k[:2] + k[3:] for _, k in keys[:60]] + corpus(rng, 30) + ["", "same kez", "same kez", None, "y" * 300 + "x" * 500, "a b", "\U0001f600 a"]
    got = similar.top_k(spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame(keys, "id long, key string"), 5)
    assert rows(got) == plain(texts, keys, 5)


def test_a_cutoff_equals_a_scan(spark, narrow):
    rng = random.Random(4)
    keys = list(enumerate(corpus(rng, 120))) + [(500 + i, "same key") for i in range(10)]
    texts = [k[:2] + k[3:] for _, k in keys[:80]] + ["", "same keyy", "z"]
    got = similar.at_least(spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame(keys, "id long, key string"), 80.0)
    assert rows(got) == {(t, id, round(s, 9)) for t in set(texts) for id, key in keys if (s := indel(t, key)) >= 80}


def test_nothing_to_search(spark):
    none, some = spark.createDataFrame([], "id long, key string"), spark.createDataFrame([(1, "a")], "id long, key string")
    text = spark.createDataFrame([("a",)], "text string")
    assert similar.top_k(text, none, 3).count() == similar.at_least(text, none, 50.0).count() == 0
    assert similar.top_k(text.limit(0), some, 3).count() == 0 and rows(similar.top_k(text, some, 3)) == {("a", 1, 100.0)}


def test_blocks_leave_most_pairs_unscored():
    rng = random.Random(5)
    keys = corpus(rng, 400)
    held = similar.Keys(keys)
    texts = [k[:1] + k[2:] for k in keys[:50]]
    i, j, ratio, scored = held.reaching(texts, np.full(50, -1.0), 3, np.arange(400))
    assert scored < 50 * 400 / 2
    for t in range(50):
        assert sorted(-ratio[i == t]) == pytest.approx(sorted(-indel(texts[t], k) for k in keys)[:3])
