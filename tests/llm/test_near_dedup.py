import itertools
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tallyloom.llm import components as module
from tallyloom.llm import lines, near_dedup
from tallyloom.llm.components import components

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingle_set(text, size):
    words = [w.lower() for w in WORD.findall((text or "").encode())]
    if len(words) < size:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(size))))


def brute(texts, size, percent=80):
    """Component of each id by comparing all pairs."""
    found, parent = {i: shingle_set(t, size) for i, t in texts}, {i: i for i, _ in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (i, a), (j, b) in itertools.combinations(found.items(), 2):
        shared = len(a & b)
        if shared and 100 * shared >= percent * (len(a) + len(b) - shared):
            x, y = root(i), root(j)
            parent[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in found.items()}


def corpus(seed, n=120):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 5, 40, 90]))) for _ in range(n // 3)]
    while len(texts) < n:
        words = rng.choice(texts[: n // 3]).split(" ")
        for _ in range(rng.randint(0, max(1, len(words) // 9))):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        texts.append(rng.choice([" ", "\t"]).join(words).upper() if rng.random() < 0.2 else " ".join(words))
    return texts


def check(spark, rows, size):
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long, key string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs, size).collect()}
    assert got == brute([(r[0], r[1]) for r in rows], size)


def test_components_equal_brute_force(spark):
    texts = [*corpus(1), "", None, " \t ", "one", "one", "ONE two", "é É", "x " * 30_000]
    check(spark, [(10 * i, t, 1, "extra") for i, t in enumerate(texts)], 2)


def test_hot_buckets_are_refined_without_a_loss(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "HOT_BUCKET", 1)
    check(spark, [(i, t, 1, "") for i, t in enumerate(corpus(2, 60))], 5)


def test_empty_table_null_ids_and_repeated_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert near_dedup.near_duplicates(docs).count() == 0
    docs = spark.createDataFrame([(2, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (1, "a b c d e f"), (3, None)], "doc_id long, text string")
    assert sorted(((r.doc_id, r.component_id) for r in near_dedup.near_duplicates(docs).collect()), key=str) == [(1, 1), (2, 1), (2, 1), (3, 3), (None, None)]
    assert sorted((r.doc_id for r in near_dedup.keep_one(docs).collect()), key=str) == [1, 3, None]


def test_signatures_hold_the_guarantee(spark):
    """Every pair within the distance has a key in common."""
    import numpy as np

    rng = np.random.default_rng(0)
    a = rng.integers(0, 256, (300, near_dedup.POSITIONS))
    b = a.copy()
    for row in b:
        row[rng.choice(near_dedup.POSITIONS, near_dedup.MAX_DISTANCE, replace=False)] ^= 1
    longs = [near_dedup._pack(x.astype(np.uint64)) for x in (a, b)]
    frames = [spark.createDataFrame([(i, *map(int, row)) for i, row in enumerate(x)], ["rep", *near_dedup.SIGNATURE]) for x in longs]
    x, y = (near_dedup.bucket_keys(f) for f in frames)
    assert x.join(y, ["key", "rep"]).select("rep").distinct().count() == len(a)


def test_union_find_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101 + i) for i in range(50)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(51)}


@pytest.mark.parametrize("order", ["ascending", "descending", "random", "far"])
def test_union_find_of_long_paths(spark, monkeypatch, order):
    n, rounds = 2000, []
    nodes = {"ascending": [*range(n)], "descending": [*range(n)][::-1], "random": random.Random(1).sample(range(n), n), "far": [0, *range(n - 1, 0, -1)]}[order]
    monkeypatch.setattr(module, "_nearest", lambda graph, salt, f=module._nearest: rounds.append(salt) or f(graph, salt))
    edges = [*zip(nodes, nodes[1:]), (5000, 5001), (5002, 5001), (6000, 6000)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(n)} | {5000: 5000, 5001: 5000, 5002: 5000}
    assert len(rounds) <= 2 * math.log2(n) + 2


def test_union_find_without_edges(spark):
    assert components(spark.createDataFrame([(7, 7)], "a long, b long")).collect() == []


@pytest.mark.parametrize("seed", [3])
def test_lines_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    texts = corpus(seed, 90)
    docs = [(i, "\n".join(rng.sample(texts, 4)) + rng.choice(["", "\n", "\n \n"])) for i in range(40)] + [(90, None), (91, "")]
    first, every = {}, []
    for i, t in docs:
        for n, line in enumerate((t or "").split("\n")):
            if line.strip():
                first.setdefault(line, (i, n))
                every.append((i, n, line))
    sets = {line: character_shingles(line) for line in first}
    parent = {line: line for line in first}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(first, 2):
        shared = len(sets[a] & sets[b])
        if 100 * shared >= 80 * len(sets[a] | sets[b]):
            parent[root(a)] = root(b)
    heads = {}
    for line in first:
        heads[root(line)] = min(heads.get(root(line), first[line]), first[line])
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc, r.at): (r.first_doc, r.first_at) for r in lines.repeats(frame).collect()}
    assert got == {(i, n): heads[root(line)] for i, n, line in every}


def character_shingles(line):
    line = line.lower()
    return {line[i : i + 5] for i in range(len(line) - 4)} or {line}


def test_line_shingles_are_taken_at_every_character(spark):
    rng = random.Random(5)
    words = "quick brown foxes jumped lazily across seventeen muddy rivers before sunrise yesterday".split()
    base = ["".join(rng.choices("漢字仮名交文章列語山川", k=60)), "https://h.example/" + "".join(rng.choices("abcdef0123456789", k=90)), "漢😀é" * 9, "ab", "x"]
    base += [" ".join(rng.sample(words, 12)) for _ in range(6)]
    typos = [b[:at] + "z" + b[at + 1 :] for b in base for at in (1, len(b) // 2)]
    every = [*dict.fromkeys(base + ["x" + b for b in base] + typos + [b.upper() for b in base])]
    sets, parent = [character_shingles(line) for line in every], list(range(len(every)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(every)), 2):
        if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            x, y = root(i), root(j)
            parent[max(x, y)] = min(x, y)
    docs = spark.createDataFrame(list(enumerate(every)), "doc_id long, text string")
    got = {r.doc: r.first_doc for r in lines.repeats(docs).collect()}
    assert got == {i: root(i) for i in range(len(every))}
    assert got[len(base)] == 0


def test_lines_that_go(spark):
    rows = [(1, "alpha beta gamma\n\nunique one", "s", 3), (2, "alpha beta gamma\nunique two", "s", 3), (3, "alpha beta gamma", "s", 3), (4, None, "s", 0), (5, "", "s", 0), (5, "", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, doc string, n_chars long")
    kept = lines.drop_repeats(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text or "", r.n_chars) for r in kept.collect()) == [(1, rows[0][1], 3), (2, "unique two", 10), (4, "", 0), (5, "", 0), (5, "", 0)]
    assert lines.drop_repeats(docs.where("false")).count() == 0


def test_rows_of_one_id_lose_only_their_own_lines(spark):
    rows = [(1, "alpha..\nkeep me one two three"), (1, "totally different text here\nalpha.."), (0, "alpha..")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted((r.doc_id, r.text) for r in lines.drop_repeats(docs).collect())
    assert kept == [(0, "alpha.."), (1, "keep me one two three"), (1, "totally different text here")]


def test_lines_that_repeat_thousands_of_times_in_long_texts(spark):
    long = "".join(random.Random(2).choices("abcdefgh ", k=50_000))
    rows = [(i, "\n".join([f"shared line of many, version {i % 3}"] * 400 + [f"{i} {long}"])) for i in range(6)] + [(9, "\n \n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id: r.text for r in lines.drop_repeats(docs).collect()}
    assert kept[0].count("shared") == 1 and kept[9] == "\n \n" and set(kept) == {0, 9}


def test_recall_of_lines_at_the_threshold(spark):
    rng = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyz      漢字仮名"
    pairs = []
    while len(pairs) < 400:
        a = "".join(rng.choices(letters, k=rng.choice([12, 30, 80, 200, 400])))
        b = list(a)
        for _ in range(max(1, len(a) // 45)):
            b[rng.randrange(len(b))] = rng.choice(letters)
        x, y = character_shingles(a), character_shingles("".join(b))
        if 0.8 <= len(x & y) / len(x | y) < 0.9:
            pairs.append((a, "".join(b)))
    rows = [(2 * i + k, line) for i, pair in enumerate(pairs) for k, line in enumerate(pair)]
    got = {r.doc: r.first_doc for r in lines.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[2 * i + 1] == 2 * i for i in range(len(pairs))) >= 0.95 * len(pairs)


def test_no_python_in_line_dedup(spark):
    frame = spark.createDataFrame([(1, "a b"), (2, "a b")], "doc_id long, text string")
    plans = [lines.repeats(frame), lines.signatures(lines.occurrences(frame)), lines.confirm(frame.selectExpr("doc_id a", "doc_id b"), lines.occurrences(frame), 80)]
    assert not any(re.search("Python|Arrow|Pandas", p._jdf.queryExecution().executedPlan().toString()) for p in plans)


def test_lines_far_below_the_threshold_are_not_read_to_be_confirmed(spark, monkeypatch):
    rng = random.Random(4)
    asked, confirm = [], lines.confirm
    monkeypatch.setattr(lines, "confirm", lambda pairs, *more: asked.append(pairs.count()) or confirm(pairs, *more))
    monkeypatch.setattr(lines, "FAR", lines.SKETCHED)
    # Every line in one bucket of each band, so that only parities tell lines apart.
    monkeypatch.setattr(lines, "band_positions", lambda band: [])
    base = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=200))
    texts = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=200)) for _ in range(60)] + [base, base + "!", base + "!?", base[1:]]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc: r.first_doc for r in lines.repeats(frame).collect()}
    assert got == {i: min(i, 60) for i in range(64)}
    assert sum(asked[1:]) <= 3 * 3 + 3  # of 1,800 pairs across components only those of the four near lines


def test_lines_of_buckets_are_not_sorted_to_meet_their_ends(spark):
    docs = spark.createDataFrame([(i, f"some line of text with the number {i}") for i in range(20)], "doc_id long, text string")
    signed = lines.signatures(lines.occurrences(docs)).localCheckpoint()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = lines._shared(signed, lines.NAMES[:6])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan and "BuildRight" in plan


def test_rounds_of_few_edges_take_one_exchange_and_one_for_their_choices(spark, monkeypatch):
    plans, stage = [], module.stage
    monkeypatch.setattr(module, "stage", lambda df, name: plans.append((name, df._jdf.queryExecution().executedPlan().toString())) or stage(df, name))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {r.node: r.component for r in components(spark.createDataFrame([(i, i + 1) for i in range(0, 80)], "a long, b long")).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {i: 0 for i in range(81)}
    moves = [plan.count("Exchange hashpartitioning") for name, plan in plans if name in ("graph", "choices")]
    assert len(moves) > 5 and set(moves) == {1}


def test_texts_of_open_buckets_are_read_once(spark, monkeypatch):
    asked, texts = [], lines._texts
    monkeypatch.setattr(lines, "_texts", lambda keys, *more: asked.append(keys) or texts(keys, *more))
    monkeypatch.setattr(lines, "FAR", lines.SKETCHED)
    monkeypatch.setattr(lines, "band_positions", lambda band: [])  # one bucket, which spans components to the end
    base = "".join(random.Random(6).choices("abcdefghijklmnopqrstuvwxyz ", k=200))
    rest = ["".join(random.Random(k).choices("abcdefghijklmnopqrstuvwxyz ", k=200)) for k in range(7, 12)]
    frame = spark.createDataFrame(list(enumerate([*rest, base, base + "!", base[1:]])), "doc_id long, text string")
    assert {r.doc: r.first_doc for r in lines.repeats(frame).collect()} == {i: min(i, 5) for i in range(8)}
    assert len(asked) == 2  # for the stars, and once for all that is still to be bounded or confirmed
