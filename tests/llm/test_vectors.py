import hashlib
import random

import numpy as np
import pytest

from tallyloom.llm import kmeans, whitening

SCHEMA = "vec_id long, embedding array<double>, cluster int, n long, x array<long>, distance string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 7, 7, [7], "clash") for i, v in rows], SCHEMA)


def lloyd(rows, k, rounds, size, seed=3, scale=1024):
    """Rounds in whole numbers, every centroid looked at."""
    kept = [(i, [int(np.floor(scale * c)) for c in v]) for i, v in rows if v is not None and len(v) == size and all(c is not None and np.isfinite(c) for c in v)]
    order = sorted((hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest(), x) for i, x in kept)
    centroids = [x for _, x in order[:k]]
    square = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b))
    for t in range(rounds + 1):
        near = [min((square(x, c), j) for j, c in enumerate(centroids)) for _, x in kept]
        if t < rounds:
            for j in range(len(centroids)):
                mine = [x for (_, x), (_, c) in zip(kept, near) if c == j]
                if mine:
                    centroids[j] = [sum(col) // len(mine) for col in zip(*mine)]
    total, each = sum(d for d, _ in near), [sum(d for d, c in near if c == j) for j in range(len(centroids))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, d, each[c], total, digest[c]) for (i, _), (d, c) in zip(kept, near)), key=str)


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


@pytest.mark.parametrize("k,bounds,coarse,seed", [(8, None, False, 1), (8, 7, True, 2), (12, 1, False, 3), (3, None, True, 4), (1, None, False, 5), (20, 5, True, 6)])
def test_clusters_equal_lloyd(spark, k, bounds, coarse, seed):
    rng = random.Random(seed)
    middle = [[rng.uniform(-1, 1) for _ in range(4)] for _ in range(6)]
    draw = lambda: [c + rng.gauss(0, 0.3) for c in rng.choice(middle)]
    rows = [(i, [round(c) * 1.0 for c in draw()] if coarse else draw()) for i in range(400)]
    rows += [(1000, rows[0][1])] * 150  # a vector that a quarter of all rows share
    found = kmeans.cluster(frame(spark, rows).repartition(5), k=k, rounds=6, size=4, bounds=bounds)
    assert rows_of(kmeans.report(found, spark)) == lloyd(rows, k, 6, 4)


def test_bounds_shrink_and_settle_most_vectors(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(m, 0.02, (200, 4)) for m in rng.uniform(-1, 1, (16, 4))])
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    found = kmeans.cluster(frame(spark, rows), k=16, rounds=5, size=4, bounds=8)
    assert found.bounds[0] == 8 and found.bounds[-1] < 8
    move = kmeans.Move(found.centroids, np.zeros(16), 4)
    state = kmeans.Bounds(np.array([[int(np.floor(1024 * c)) for c in v] for v in x]), move)
    state.scan(np.arange(len(x)))
    state.scanned = 0
    state.load(state.cluster, state.upper, state.near, state.lower, state.remainder)
    state.settle()
    assert state.scanned == 0


def test_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    bad = [(1, None), (2, []), (3, [1.0] * 3), (4, [1.0, None, 1.0, 1.0]), (5, [1.0, nan, 0.0, 0.0]), (6, [inf, 0.0, 0.0, 0.0])]
    good = [(None, [0.5, 0.0, 0.0, 0.0]), (None, [0.5, 0.0, 0.0, 0.0]), (7, [0.0] * 4), (7, [9e4, -9e4, 0.0, 1.0]), (8, [1e12, 1e12, -1e12, 0.0]), (9, [-0.0001, 0.0, 0.0, 0.0])]
    found = kmeans.cluster(frame(spark, bad + good), k=3, rounds=4, size=4)
    want = [(i, c, min(d, kmeans.MOST), min(e, kmeans.MOST), min(t, kmeans.MOST), h) for i, c, d, e, t, h in lloyd(bad + good, 3, 4, 4)]
    assert rows_of(kmeans.report(found, spark)) == want
    few = kmeans.cluster(frame(spark, good[:3]), k=8, rounds=2, size=4)
    assert rows_of(kmeans.report(few, spark)) == lloyd(good[:3], 8, 2, 4)
    far = kmeans.cluster(frame(spark, [(1, [1e300, -1e300, 0.0, 0.0]), (2, [0.0] * 4), (3, [1.0] * 4)]), k=2, rounds=2, size=4)
    assert kmeans.report(far, spark).count() == 3
    for none in (bad, []):
        assert kmeans.report(kmeans.cluster(frame(spark, none), size=4), spark).count() == 0


def plain_whitening(rows, k):
    kept = [(i, tuple(int(np.floor(64 * c)) + 1_000_000 for c in v)) for i, v in rows]
    distinct = sorted({x for _, x in kept})
    n, sums = len(distinct), [sum(c) for c in zip(*distinct)]
    away = lambda x: [n * a - s for a, s in zip(x, sums)]
    centred = np.array([[a / n for a in away(x)] for x in distinct])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(values)[::-1][:k]
    return kept, n, away, values[order], vectors[:, order], values.sum()


def test_whitening_equals_numpy(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 20)) * np.linspace(1, 3, 20) @ rng.normal(size=(20, 20))
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(900, [float(c) for c in x[0]])] * 140
    kept, n, away, values, vectors, trace = plain_whitening(rows, 16)
    got = whitening.whiten(frame(spark, rows).repartition(4)).collect()
    assert len(got) == 16 * len(rows) and {r.n for r in got} == {n} == {300}
    assert max(r.identity_error for r in got) < 1e-9
    sign, by = {}, {}
    for r in got:
        by.setdefault(r.vec_id, {})[r.component] = r
    for i, v in kept:
        whole = away(v)
        want = np.array([w / n for w in whole]) @ vectors / np.sqrt(values)
        for c in range(1, 17):
            r = by[i][c]
            assert r.deviation == sum(w * w for w in whole)
            sign.setdefault(c, np.sign(r.whitened * want[c - 1]))
            assert r.whitened == pytest.approx(sign[c] * want[c - 1], abs=1e-8)
            assert r.explained == pytest.approx(values[c - 1] / trace, rel=1e-9)


def test_odd_rows_are_whitened_or_dropped(spark):
    inf, nan = float("inf"), float("nan")
    bad = [(1, None), (2, []), (3, [1.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [1.0, inf])]
    good = [(None, [0.5, 0.25]), (None, [0.5, 0.25]), (7, [1.0, 3.0]), (7, [-1.0, 2.0]), (8, [0.0, -2.0])]
    got = whitening.whiten(frame(spark, bad + good)).collect()
    assert sorted((r.component, str(r.vec_id)) for r in got) == sorted((c, str(i)) for i, _ in good for c in (1, 2))
    assert {r.n for r in got} == {4} and all(r.identity_error < 1e-9 for r in got)
    one = whitening.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert len(one) == 4 and all((r.n, r.deviation, r.whitened, r.explained, r.identity_error) == (1, 0, None, None, None) for r in one)
    line = whitening.whiten(frame(spark, [(i, [float(i), 2.0 * i]) for i in range(5)])).collect()
    assert all((r.whitened is None) == (r.component == 2) for r in line) and line[0].identity_error < 1e-9
    far = whitening.whiten(frame(spark, [(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [1e6, 5.0]), (4, [3e9, 5.0])])).collect()
    assert len(far) == 8 and all(r.deviation is None for r in far)
    for none in (bad[:2] + bad[3:], []):
        assert whitening.whiten(frame(spark, none)).count() == 0


def test_exactly_centred_beyond_longs(spark):
    rows = [(i, [float(i) * 1e11, float(i * i)]) for i in range(6)]
    kept, n, away, values, vectors, trace = plain_whitening(rows, 2)
    got = whitening.whiten(frame(spark, rows)).orderBy("vec_id", "component").collect()
    assert [r.deviation for r in got[::2]] == [d if (d := sum(w * w for w in away(v))) < 1 << 63 else None for _, v in kept]
    assert got[0].explained == pytest.approx(values[0] / trace, rel=1e-6)

