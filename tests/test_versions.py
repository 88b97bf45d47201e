import threading
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import feedback, merges
from tallyloom.sources import invoices, versions
from tallyloom.staging import checkpoint_dir
from tallyloom.streaming.files import import_stream, missing_stream

OVERRIDES = "raw string, mapped string, version long"
LOG = "original_text string, recorded_at long, party string"


def overrides(spark, rows):
    return spark.createDataFrame(rows, OVERRIDES)


def held(spark, path):
    return {(r.key, r.mapped, r.version) for r in versions.read(spark, path).collect()}


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    path, first = str(tmp_path / "t"), overrides(spark, [(f"Name {i}", f"m{i}", i) for i in range(400)])
    before = versions.create(merges.keyed_overrides(first), path, "key", buckets=32)
    changes = overrides(spark, [("name 7", "new", 1000), ("NAME  8", "old", -1), ("fresh", " x ", 1001), (" ", "blank", 1002), ("name 9", " ", 1003), (None, "y", 1)])
    after = feedback.save_overrides(changes, path)
    moved = {b for b in before.folders if before.folders[b] != after.folders.get(b)}
    assert 1 <= len(moved) <= 3 and after.number == 2 and len(before.folders) == 32
    want = {(r.raw, r.mapped, r.version) for r in merges.upsert_overrides(first, changes).collect()}
    assert {(r.raw, r.mapped, r.version) for r in versions.read(spark, path).collect()} == want and len(want) == 401
    assert versions.read(spark, path, 1).count() == 400
    files = {f for f in Path(path, "data").rglob("*.parquet")}
    versions.drop_before(spark, path, 2)
    left = {f for f in Path(path, "data").rglob("*.parquet")}
    assert left < files and len(files - left) == len(moved) and held(spark, path) >= {("name 7", "new", 1000), ("fresh", "x", 1001)}
    with pytest.raises(FileNotFoundError):
        versions.latest(spark, str(tmp_path / "none"))
    with pytest.raises(FileExistsError):
        versions.create(merges.keyed_overrides(first), str(tmp_path / "t2"), "key", buckets=2)
        versions.create(merges.keyed_overrides(first), str(tmp_path / "t2"), "key", buckets=2)


def test_odd_tables(spark, tmp_path):
    path, none = str(tmp_path / "t"), overrides(spark, [])
    versions.create(merges.keyed_overrides(none), path, "key", buckets=4)
    assert versions.read(spark, path).columns == ["key", "raw", "mapped", "version"] and held(spark, path) == set()
    assert feedback.save_overrides(none, path).number == 2
    wide = overrides(spark, [("a" * 100_000, "x", 1), ("b", "y", 2), ("B ", "z", 2)]).withColumns({"key": F.lit("k"), "__bucket": F.lit("9")})
    feedback.save_overrides(wide, path)
    assert {(len(k), m) for k, m, _ in held(spark, path)} in ({(100_000, "x"), (1, "y")}, {(100_000, "x"), (1, "z")})
    with pytest.raises(ValueError):
        versions.change(merges.keyed_overrides(wide.limit(1)), path, lambda rows, _: merges.keyed_overrides(overrides(spark, [(str(i), "x", 1) for i in range(50)])))
    items = str(tmp_path / "i")
    versions.create(spark.createDataFrame([("one", "One")], "key string, item string"), items, "key")
    feedback.save_ignored(spark.createDataFrame([(" ONE", "two"), (None, None), ("", " "), ("Two ", "Two")], "raw string, matched string"), items)
    assert {r.key for r in versions.read(spark, items).collect()} == {"one", "two"}


def test_writers_at_once_lose_nothing(spark, tmp_path):
    path, errors, counts = str(tmp_path / "t"), [], []
    versions.create(merges.keyed_overrides(overrides(spark, [("start", "x", 0)])), path, "key", buckets=2)
    done = threading.Event()

    def write(w):
        try:
            for i in range(4):
                rows = merges.keyed_overrides(overrides(spark, [(f"w{w} {i}", "x", i), ("shared", f"w{w}", 10 * i + w)]))
                versions.change(rows, path, lambda old, new: merges.upsert(old, new, "key", "version"), tries=20)
        except Exception as e:
            errors.append(e)

    def look():
        while not done.is_set():
            try:
                counts.append(versions.read(spark, path).count())
            except Exception as e:
                errors.append(e)

    writers, reader = [threading.Thread(target=write, args=(w,)) for w in range(3)], threading.Thread(target=look)
    for t in (*writers, reader):
        t.start()
    for t in writers:
        t.join()
    done.set()
    reader.join()
    assert not errors and counts == sorted(counts) and counts
    assert held(spark, path) == {("start", "x", 0), ("shared", "w2", 32)} | {(f"w{w} {i}", "x", i) for w in range(3) for i in range(4)}
    assert versions.latest(spark, path).number == 13


def test_a_lost_race_merges_anew(spark, tmp_path):
    path, calls = str(tmp_path / "t"), []
    versions.create(merges.keyed_overrides(overrides(spark, [("a", "x", 0)])), path, "key", buckets=1)

    def merge(rows, changes):
        calls.append(1)
        if len(calls) == 1:  # another writer comes first
            feedback.save_overrides(overrides(spark, [("b", "y", 1)]), path)
        return merges.upsert(rows, changes, "key", "version")

    versions.change(merges.keyed_overrides(overrides(spark, [("c", "z", 2)])), path, merge)
    assert len(calls) == 2 and {k for k, *_ in held(spark, path)} == {"a", "b", "c"}


def test_texts_are_logged_once_over_restarts(spark, tmp_path):
    log, source = str(tmp_path / "log"), str(tmp_path / "in")
    feedback.new_log(spark.createDataFrame([("Old", 0, "p"), (None, 0, "p")], LOG), log, buckets=8)
    staged = Path(checkpoint_dir(spark)) / "tallyloom"
    before = set(staged.iterdir()) if staged.exists() else set()

    def run(rows):
        spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(source)
        missing_stream(spark, source, log, str(tmp_path / "state"), LOG).awaitTermination()
        return sorted((r.original_text or "", r.recorded_at) for r in versions.read(spark, log).collect())

    first = run([("New", 2, "p"), ("new ", 1, "q"), ("OLD", 1, "p"), ("", 1, "p"), (None, 1, "p"), ("", 1, "p")])
    assert first == [("", 0), ("", 1), ("", 1), ("", 1), ("Old", 0), ("new ", 1)]
    second = run([("NEW", 0, "p"), ("Third", 5, "p"), (" ", 5, "p")])
    assert second == sorted([*first, (" ", 5), ("Third", 5)])
    again = spark.createDataFrame([("fourth", 9, "p"), ("", 9, "p")], LOG)
    number = versions.latest(spark, log).number
    assert feedback.log_missing(again, log, applied=("missing", 1)).number == number  # a batch that runs again
    assert feedback.log_missing(again, log, applied=("other", 0)).number == number + 1
    assert (set(staged.iterdir()) if staged.exists() else set()) <= before


def test_records_without_a_text_spread(spark, tmp_path):
    rows = spark.range(2000).select(F.lit(" ").alias("original_text"), F.col("id").alias("recorded_at"), F.lit("p").alias("party"))
    log = feedback.new_log(rows, str(tmp_path / "t"), buckets=16)
    sizes = [spark.read.parquet(f"{tmp_path}/t/data/{f}/__bucket={b}").count() for b, f in log.folders.items()]
    assert len(sizes) == 16 and max(sizes) < 250 and sum(sizes) == 2000


def test_the_first_of_a_text(spark):
    log = spark.createDataFrame([("x", 5, "p")], LOG)
    new = spark.createDataFrame([("Y", 3, "b"), ("y", 2, "z"), ("y", 2, "a"), ("X", 0, "p"), ("Z", None, "p"), ("z", 1, "p")], LOG).withColumn("extra", F.lit(1))
    assert sorted(tuple(r) for r in merges.append_missing(log, new).collect() if r.recorded_at is not None) == [("x", 5, "p"), ("y", 2, "a")]
    assert merges.append_missing(log, new).where("recorded_at is null").first().original_text == "Z"
    assert merges.append_missing(log, new.limit(0)).count() == 1


def test_files_are_imported_once_over_restarts(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()

    def extract(content):
        if content == b"bad":
            raise ValueError("no pages")
        return [([[["Product"], [content.decode()]]], "")]

    def run(**files):
        for name, content in files.items():
            (folder / f"{name}.pdf").write_bytes(content)
        import_stream(spark, str(folder), out, str(tmp_path / "state"), extract, invoices.read_files).awaitTermination()
        return sorted(r.name for r in spark.read.parquet(f"{out}/rows").collect())

    assert run(a=b"one", b=b"bad") == ["one"]
    assert run(c=b"two") == ["one", "two"] == run()
    assert spark.read.parquet(f"{out}/failed").count() == 1
