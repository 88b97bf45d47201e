"""What moves and what is worked out once, where tables grow: plans of queries that were slow or large on many rows."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tallyloom.functions import text
from tallyloom.sources import invoices

SF = "/root/testdata/sf0.001"


def plan(df):
    df.collect()
    full = df._jdf.queryExecution().executedPlan().toString()
    return re.split(r"== Initial Plan ==", full)[0]


def test_white_space_is_that_of_unicode(spark):
    rows = spark.range(1, 0x10000).where("id not between 55296 and 57343").select(F.col("id"), F.expr("decode(encode(decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32'), 'UTF-8'), 'UTF-8')").alias("c"))
    rows = rows.select("id", F.concat(F.lit("a"), "c", "c", F.lit("b"), "c", F.lit(" "), F.lit("d"), "c").alias("x"))
    slow = F.regexp_replace(F.regexp_replace("x", r"(?U)\s+", " "), r"(?U)^\s+|\s+$", "")
    assert rows.where(text.collapse(F.col("x")) != slow).count() == 0
    assert rows.where(text.collapse(F.col("x")) == "a b d").count() == len(text.SPACES)


def test_ends_are_not_searched_for_each_white_space_where_none_can_be(spark):
    cells = spark.createDataFrame([("\u3000\x85a\t ",), ("\xa0-1,200.5 \u2003",), (" \n",), (None,)], "c string").select(text.collapse(F.col("c")).alias("c"), text.parse_number(F.col("c")).alias("n"))
    assert [tuple(r) for r in cells.collect()] == [("a", None), ("-1,200.5", -1200.5), ("", None), (None, None)]
    assert "\u3000)" not in plan(cells) and "Some(" not in plan(cells)


def test_header_cells_are_normalised_once_for_all_kinds(spark):
    assert "regexp_replace" not in plan(__spark_entry__.queries()["header_detect"](spark, SF))
    heads = spark.createDataFrame([(["Unit\n PRICE", None, "QTY", "unit"],), ([],), (None,)], "h array<string>")
    found = heads.select(invoices.find_columns(F.col("h"), {"u": ["unit price"], "q": ["lot qty", "qty"], "n": ["name"]}).alias("f")).select("f.*").collect()
    assert [tuple(r) for r in found] == [(0, 2, None), (None, None, None), (None, None, None)]


def test_words_of_a_page_do_not_move(spark):
    moved = re.findall(r"Exchange hashpartitioning\((\w+)", plan(__spark_entry__.queries()["layout_tables"](spark, SF)))
    assert moved.count("path") == 1


def test_words_of_a_page_are_laid_out_at_once(spark):
    made = plan(__spark_entry__.queries()["layout_tables"](spark, SF))
    assert len(re.findall(r"\bWindow \[", made)) == 1 and made.count("ObjectHashAggregate(") == 2  # an order's lines are numbered and gathered


def test_tables_and_text_of_a_file_meet_where_they_lie(spark):
    moved = re.findall(r"Exchange hashpartitioning\((\w+)", plan(__spark_entry__.queries()["scan_fallback"](spark, SF)))
    assert len(moved) == 3  # lines by file, for its rows, for whether it has any, and for its text


def test_features_of_a_catalog_in_one_file_are_found_by_all_tasks_once_a_name(spark):
    from tallyloom.operators import lookups

    rows = spark.range(400).select(F.col("id").alias("idx"), F.lit("c").alias("code"), F.when(F.col("id") % 20 > 0, F.concat(F.lit("name "), F.col("id") % 20)).alias("name"), F.lit(1.0).alias("price"))
    found = lookups.catalog_features(rows.coalesce(1))
    assert plan(found).count("REPARTITION_BY_NUM") >= 2
    assert found.count() == 400 and found.where("name is null and search_key = ''").count() == 20
    assert found.where("name = 'name 7' and numbers = array('7') and anchor = 'name'").count() == 20


def test_a_least_score_leaves_out_what_is_below_it_and_nothing_else(spark):
    from tallyloom.operators.similar import top_k

    keys = spark.range(900).select("id", F.concat(F.lit("PTY"), "id", F.lit("/Stock")).alias("key"))
    texts = spark.range(0, 900, 7).select(F.explode(F.array(F.concat(F.lit("PTX"), "id", F.lit("/Stock")), F.concat(F.lit("Q/"), "id", F.lit("ZZZZZZZZ")))).alias("text"))
    every = {tuple(r) for r in top_k(texts, keys, 2).collect()}
    for least in (75.0, 90.0):
        assert {tuple(r) for r in top_k(texts, keys, 2, least).collect()} == {r for r in every if r[2] >= least} != every


def test_no_table_of_the_cascade_grows_with_lines_of_one_text(spark, monkeypatch):
    from tallyloom.plans import cascade

    held, stage = {}, cascade.stage
    monkeypatch.setattr(cascade, "stage", lambda df, name: held.setdefault(name, stage(df, name)))
    names = [(0, "A", "زانوفارم ايكسترا 24 أقراص", 30.0), (1, "B", "ليبونيل 20 مجم 28 قرص", 50.0)]
    catalog = spark.createDataFrame(names, "idx long, code string, name string, price double")
    dims = cascade.Dimensions(catalog, ignored=spark.createDataFrame([("ليبونيل 20 مجم 28 قرص",), ("Other",)], "item string"), controlled=spark.createDataFrame([("زانوفارم",)], "name string"))
    texts = F.element_at(F.array(F.lit("ليبونيل 20 مجم 28 قرصص"), F.lit(" other "), F.lit("زانوفارم ايكسترا 24 أقراص"), F.lit(None)), (F.col("id") % 4 + 1).cast("int"))
    lines = spark.range(800).select(texts.alias("text"), F.col("id").cast("double").alias("invoice_price"), F.lit(1.0).alias("quantity"))
    found = cascade.match(lines, dims).groupBy("original_text", "suggested_arabic", "ignored", "controlled").count().collect()
    assert {tuple(r) for r in found} == {
        ("ليبونيل 20 مجم 28 قرصص", names[1][2], True, False, 200), (" other ", "", True, False, 200), (names[0][2], names[0][2], False, True, 200), (None, "", False, False, 200),
    }
    assert held and max(t.count() for t in held.values()) < 20
