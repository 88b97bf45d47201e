import pytest

from tallyloom.queries import QUERIES


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("small"))
    part = spark.read.parquet("/root/testdata/sf0.001/part.parquet").orderBy("p_partkey").limit(60).coalesce(1)
    part.write.parquet(f"{folder}/part.parquet")
    return folder


def ratio(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return 200.0 * row[-1] / (len(a) + len(b))


def test_fuzzy_queries_ask_for_every_product(spark, small):
    part = spark.read.parquet(f"{small}/part.parquet").collect()
    names = {r.p_partkey: f"{r.p_name} {r.p_brand} {r.p_type} {r.p_size}mg" for r in part}
    order = lambda x: " ".join(sorted(x.split()))
    want = {}
    for q in {n[:3] + n[4:] for n in names.values()}:
        best = sorted((-ratio(order(q), order(n)), i) for i, n in names.items())[:8]
        want |= {(q, r): (i, round(-s, 4)) for r, (s, i) in enumerate(best, 1)}
    assert len(want) > 8 * len({r.p_brand for r in part})
    assert {(r.candidate, r["rank"]): (r.idx, r.score) for r in QUERIES["fuzzy_top8_whole"](spark, small).collect()} == want
    asked = {q for q, _ in want}
    assert {r.candidate for r in QUERIES["threshold_qualify_whole"](spark, small).collect()} == asked


def test_ignored_and_missing_take_the_whole_table(spark, small):
    part = spark.read.parquet(f"{small}/part.parquet").collect()
    names = {f"{r.p_name} {r.p_brand} {r.p_type} {r.p_size}mg" for r in part}
    items = [f"{r.p_name} {r.p_type} {r.p_brand} {r.p_size}mg".lower() for r in part]
    got = {r.text: r.ignored for r in QUERIES["ignored_flag_whole"](spark, small).collect()}
    assert got == {n: any(ratio(n.lower(), i) >= 90 for i in items) for n in names}
    log = [(r.p_name, r.p_partkey) for r in part if r.p_partkey % 2 == 0]
    known, new = {n.lower() for n, _ in log}, {}
    for r in sorted(part, key=lambda r: r.p_partkey):
        if r.p_partkey % 2 and r.p_name.lower() not in known:
            new.setdefault(r.p_name.lower(), (r.p_name.upper(), r.p_partkey))
    rows = QUERIES["missing_append_dedupe"](spark, small).select("original_text", "recorded_at").collect()
    assert sorted(map(tuple, rows)) == sorted(log + list(new.values()))
