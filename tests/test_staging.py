import threading

from tallyloom.staging import checkpoint_dir, outlive, stage, staging, unstage


def there(frame):
    import os

    return [os.path.exists(f.removeprefix("file://")) for f in frame]


def test_empty_scopes_within_empty_scopes(spark):
    with staging(spark):
        with staging(spark):
            pass
        with staging(spark):
            inner = stage(spark.range(3), "x")
            kept = outlive(stage(spark.range(4), "y"))
        assert there(inner.inputFiles()) == [False] * len(inner.inputFiles()) or not any(there(inner.inputFiles()))
        assert kept.count() == 4
        files = kept.inputFiles()
    assert not any(there(files))


def test_a_table_can_go_early_and_folders_by_value(spark):
    with staging(spark):
        by = stage(spark.range(6).selectExpr("id % 2 as part", "id"), "z", by="part")
        assert by.columns == ["id", "part"] and by.where("part = 1").count() == 3
        unstage(by)
    assert checkpoint_dir(spark)


def test_threads_have_scopes_of_their_own(spark):
    first, done, seen = threading.Event(), threading.Event(), []

    def one():
        with staging(spark):
            frame = stage(spark.range(5), "one")
            first.set()
            done.wait(60)
            seen.append(frame.count())

    thread = threading.Thread(target=one)
    thread.start()
    first.wait(60)
    with staging(spark):
        stage(spark.range(2), "two")
    done.set()
    thread.join()
    assert seen == [5]


def test_ratio_takes_any_expression(spark):
    from pyspark.sql import functions as F

    from tallyloom.functions import features, similarity

    rows = spark.createDataFrame([("ab 12 abcd", "abce x")], "a string, b string")
    assert rows.select(similarity.ratio(features.anchor(F.col("a")), features.anchor(F.col("b"))).alias("r")).first().r == 75.0
    assert rows.select(similarity.ratio(F.array_join(features.core_tokens(F.col("a")), " "), F.col("b")).alias("r")).first().r > 0
