import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import mixing, topk, warc


def test_budgets_go_to_siblings_before_ancestors():
    mix = mixing.Mix(["d", "s"], {("a",): 1.0, ("b",): 1.0}, max_epochs=1)
    got = mixing.budgets(mix, {("a", "x"): 10, ("a", "y"): 100, ("b", "z"): 100}, 120)
    assert got == {("a", "x"): 10, ("a", "y"): 50, ("b", "z"): 60}
    got = mixing.budgets(mix, {("a", "x"): 10, ("a", "y"): 20, ("b", "z"): 100}, 120)
    assert got == {("a", "x"): 10, ("a", "y"): 20, ("b", "z"): 90}
    assert sum(mixing.budgets(mix, {("a", "x"): 10, ("b", "z"): 5}, 120).values()) == 15
    assert mixing.budgets(mix, {}, 5) == {}


def plain_selection(rows, mix, target):
    """Copies of each id by sorting every leaf's documents."""
    leaves = {}
    for id, source, tokens, place in rows:
        leaves.setdefault((source,), []).append((place, id, tokens))
    given = mixing.budgets(mix, {k: sum(t for *_, t in v) for k, v in leaves.items()}, target)
    out = {}
    for leaf, docs in leaves.items():
        total = sum(t for *_, t in docs)
        epochs, rest = divmod(int(given[leaf] + 1e-6), total) if total else (0, 0)
        used, open_ = 0, rest > 0
        for _, id, tokens in sorted(docs):
            used += tokens
            open_ = open_ and used <= rest
            out[id] = epochs + open_
    return out


@pytest.mark.parametrize("bits", [2, 12])
def test_prefixes_equal_a_sort(spark, monkeypatch, bits):
    monkeypatch.setattr(mixing, "RANGE_BITS", bits)
    rng = random.Random(bits)
    rows = [(i, rng.choice(["a", "a", "b", None]), "w " * rng.randint(0, 30), 1) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, copies0 long")
    mix = mixing.Mix(["source"], {("a",): 1.0, ("b",): 3.0, (None,): 1.0}, max_epochs=3, seed=5)
    target = 900
    sizes = docs.select("doc_id", "source", mixing.n_tokens(F.col("text")).alias("t")).collect()
    tokens = {r.doc_id: r.t for r in sizes}
    totals = {}
    for r in sizes:
        totals[(r.source,)] = totals.get((r.source,), 0) + r.t
    given = mixing.budgets(mix, totals, target)
    epoch = {k: int(given[k] + 1e-6) // v for k, v in totals.items()}
    placed = spark.createDataFrame([(i, s, epoch[(s,)]) for i, s, *_ in rows], "doc_id long, source string, e int")
    place = {r.doc_id: r.p for r in placed.select("doc_id", mixing._order(mix, F.col("e"), "doc_id").alias("p")).collect()}
    want = plain_selection([(i, s, tokens[i], place[i]) for i, s, *_ in rows], mix, target)
    got = {r.doc_id: r.copies for r in mixing.select(docs, mix, target=target).collect()}
    assert got == {i: n for i, n in want.items() if n}
    repeated = mixing.select(docs, mix, target=target, repeat=True)
    assert repeated.columns == docs.columns and repeated.count() == sum(want.values())


def test_mixing_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, "s"), (None, "a b", None), (2, "", "s"), (2, "x", "s")], "doc_id long, text string, source string")
    mix = mixing.Mix(["source"], max_epochs=1)
    assert mixing.select(docs.where("false"), mix, share=1.0).count() == 0
    assert mixing.select(docs, mix, share=1.0).where("copies = 1").count() >= 2
    with pytest.raises(ValueError):
        mixing.plan(docs, mixing.Mix(["source"], max_leaves=1), share=1.0)


def plain_search(vectors, asked, k):
    whole = {i: [int(np.floor(256 * float(x))) for x in v] for i, v in vectors}
    out = []
    for q in asked:
        scored = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return out


@pytest.mark.parametrize("copies", [0, 300])
def test_search_equals_brute_force(spark, copies, monkeypatch):
    monkeypatch.setattr(topk, "ANNULUS", 16)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 7)
    rng = np.random.default_rng(copies)
    centres = rng.normal(size=(6, 8))
    vectors = [(i, (centres[i % 6] + 0.2 * rng.normal(size=8)).tolist()) for i in range(250)]
    vectors += [(1000 + i, vectors[3][1]) for i in range(copies)]
    bad = [(5000, None), (5001, [1.0, None] + [0.0] * 6), (5002, [float("nan")] * 8), (5003, [float("inf")] * 8), (5004, []), (5005, [1.0])]
    frame = spark.createDataFrame(vectors + bad, "vec_id long, embedding array<double>")
    asked = [i for i, _ in vectors if i % 25 == 0]
    got = [tuple(r) for r in topk.search(frame, frame.where("vec_id % 25 = 0"), 5).orderBy("query_id", "rank").collect()]
    assert got == plain_search(vectors, sorted(asked), 5)


def test_search_of_few_or_no_rows(spark):
    frame = spark.createDataFrame([(0, [1.0, 2.0]), (1, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.search(frame, frame, 5).orderBy("query_id").collect()] == [(0, 1, 1, 256 * 128 + 512 * 128), (1, 1, 0, 256 * 128 + 512 * 128)]
    assert topk.search(frame.where("false"), frame.where("false"), 5).count() == 0


PAGES = [(i, f"http://h/{i}", f"<p>page {i}</p>\r\n\r\nWARC text é") for i in range(40)] + [(2000, None, None), (None, "u", "x")]


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, offset long")


def test_files_are_read_back_at_their_offsets(spark, tmp_path):
    records = warc.records(pages(spark))
    warc.write(records, str(tmp_path / "w"))
    back = {(r.record_id, r.url, r.html) for r in warc.read(spark, str(tmp_path / "w")).collect() if r.complete}
    assert back == {(i, u or "", h or "") for i, u, h in PAGES}
    for r in warc.layout(records).collect():
        (file,) = (tmp_path / "w" / f"warc_file={r.warc_file}").glob("part-*")
        part = file.read_bytes()[r.offset : r.offset + r.length]
        assert part.startswith(b"WARC/1.0\r\n") and part.endswith(b"\r\n\r\n")


def test_audit_finds_all_that_differs(spark, monkeypatch):
    monkeypatch.setattr(warc, "FAN_OUT", 4)
    original = warc.layout(warc.records(pages(spark)))
    assert warc.audit(original, original).count() == 0
    changed = [(i, u, h.replace("page", "rott") if i == 5 else h) for i, u, h in PAGES if h is not None]
    found = warc.audit(original, warc.layout(warc.records(pages(spark, changed))))
    got = {(r.record_id, r.status) for r in found.collect()}
    assert got == {(5, "corrupt"), (2000, "missing")}
    longer = [(i, u, (h or "") + "!" * (i == 38)) for i, u, h in PAGES] + [(41, "new", "x")]
    got = {(r.record_id, r.status) for r in warc.audit(original, warc.layout(warc.records(pages(spark, longer)))).collect()}
    assert got == {(38, "corrupt"), (39, "moved"), (41, "extra")}
    assert warc.audit(warc.layout(warc.records(pages(spark).where("false"))), original).where("status = 'extra'").count() == len(PAGES)


def test_records_that_quote_a_record_and_line_ends_in_urls(spark, tmp_path):
    quoting = "a\r\n\r\nWARC/1.0\r\nContent-Length: 3\r\n\r\nxyz\r\n\r\n"
    rows = [(1, "http://h/1", quoting), (2, "http://h/2\r\nContent-Length: 1", "é" * 5), (3, "u", ""), (None, "u", quoting), (None, "v", "y")]
    records = warc.records(pages(spark, rows))
    warc.write(records, str(tmp_path / "w"))
    found = warc.read(spark, str(tmp_path / "w"))
    back = {(r.record_id, r.url, r.html, r.complete) for r in found.collect()}
    assert back == {(i, u.replace("\r", "%0D").replace("\n", "%0A"), h, True) for i, u, h in rows}
    assert warc.audit(warc.layout(records), warc.stored_layout(found)).count() == 0


def test_stored_files_are_audited(spark, tmp_path):
    records = warc.records(pages(spark))
    folder = tmp_path / "w"
    warc.write(records, str(folder))
    (file,) = (folder / "warc_file=part-00000000").glob("part-*")
    data = file.read_bytes()
    rotten = data.replace(b"http://h/7\r", b"http://h/X\r").replace(b"<p>page 9</p>", b"<p>page</p>")
    assert rotten != data
    file.write_bytes(rotten)
    (folder / "warc_file=part-00000000" / f".{file.name}.crc").unlink(missing_ok=True)
    found = warc.read(spark, str(folder))
    assert [r.record_id for r in found.where("not complete").collect()] == [9]
    status = {r.record_id: r.status for r in warc.audit(warc.layout(records), warc.stored_layout(found)).collect()}
    assert status[7] == "corrupt" and status[9] == "corrupt"
    assert set(status) == {7, 9} | set(range(10, 40)) and all(status[i] == "moved" for i in range(10, 40))
