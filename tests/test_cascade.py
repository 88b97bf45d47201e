import pytest

from tallyloom.operators import merges, semijoins
from tallyloom.plans.cascade import Dimensions, match, rematch

CATALOG = [
    (0, "A1", "زانوفارم ايكسترا 24 أقراص", 30.0), (1, "A2", "زانوفارم اكسترا 12 قرص", 15.0), (2, "A3", "ليبونيل 20 مجم 28 قرص", 50.0),
    (3, "A4", "كتافورم 50 مجم اقراص (سعر جديد)", 20.0), (4, "A5", "اوجمافين 600 مجم شراب", 90.0), (5, "A6", "اوجمافين 600 مجم شراب", 91.0),
]


@pytest.fixture(scope="module")
def catalog(spark):
    return spark.createDataFrame(CATALOG, "idx long, code string, name string, price double")


def results(spark, catalog, lines, **dims):
    rows = spark.createDataFrame(lines, "text string, invoice_price double, quantity double")
    return {r.original_text: r for r in match(rows, Dimensions(catalog, **dims)).collect()}


def test_tiers_in_their_order(spark, catalog):
    found = results(
        spark, catalog,
        [("Known  RAW", None, 1.0), ("mapped thing", 5.0, None), ("كتافورم 50 مجم اقراص", None, None), ("اوجمافين 600 مجم شرابب", 90.4, None),
         ("اوجمافين 999 مجم شراب", 90.0, None), ("", None, None), (None, None, None)],
        overrides=spark.createDataFrame([("known raw", "first", 1), ("KNOWN raw", "اسم", 2), ("blank", " ", 3)], "raw string, mapped string, version long"),
        reference_map=spark.createDataFrame([("Mapped  Thing", "A5", 1), ("known raw", "A1", 2)], "english string, code string, version long"),
        ignored=spark.createDataFrame([("known raw",)], "item string"), controlled=spark.createDataFrame([("كتافورم",)], "name string"),
    )
    r = found["Known  RAW"]
    assert (r.source, r.suggested_arabic, r.score, r.color, r.ignored) == ("exception", "اسم", 100.0, "green", True)
    r = found["mapped thing"]
    assert (r.source, r.score, r.price_verified, r.matched_code) == ("reference_map", 98.0, True, "A5")
    r = found["كتافورم 50 مجم اقراص"]
    assert (r.source, r.score, r.suggested_arabic, r.controlled) == ("database", 98.0, CATALOG[3][2], True)
    r = found["اوجمافين 600 مجم شرابب"]
    assert (r.source, r.matched_code, r.price_verified, r.score) == ("database", "A5", True, 98.0)
    r = found["اوجمافين 999 مجم شراب"]
    assert r.source == "unmatched" and r.color == "red" and r.score > 80 and r.suggested_arabic == "" and r.rejected_by_guard
    assert found[""].source == found[None].source == "unmatched"


def test_price_only_chooses_among_those_over_the_threshold(spark, catalog):
    found = results(spark, catalog, [("اوجمافين 600 مجم شرابب", 91.3, None), ("زانوفارم ايكسترا 12 أقراص", 15.0, None)])
    assert found["اوجمافين 600 مجم شرابب"].matched_code == "A6"
    assert found["زانوفارم ايكسترا 12 أقراص"].suggested_arabic == CATALOG[1][2]  # by its number, not by its score


def test_accepted_names_are_the_catalog_s(spark, catalog):
    found = results(spark, catalog, [(name[:5] + name[6:], price, 1.0) for _, _, name, price in CATALOG])
    names = {c[2] for c in CATALOG} | {""}
    assert all(r.suggested_arabic in names and r.score <= 98 for r in found.values() if r.source == "database")


def test_rematch_keeps_what_is_not_accepted(spark, catalog):
    rows = spark.createDataFrame([("ليبونيل  20 مجم 28 قرص",), ("غير معروف",)], "text string")
    assert {r.text: r.name for r in rematch(rows, catalog).collect()} == {"ليبونيل  20 مجم 28 قرص": CATALOG[2][2], "غير معروف": "غير معروف"}


def test_parties(spark):
    directory = spark.createDataFrame([(0, "AB/Stock", "P1"), (1, "QRS/Main/X", "P2"), (2, "ZZLONG/Stock", "P3"), (3, "QRS/Other", "P4")], "pos long, code string, name string")
    headers = ["To: ab/stock x", "given to AB-1 here", "To: ZZLONK/Stock", "To: UVW/None", "QRS alone", " "]
    rows = semijoins.resolve_party(spark.createDataFrame([(h,) for h in headers], "header string"), directory).collect()
    assert {r.header: (r.party, r.matched, r.tier) for r in rows} == {
        headers[0]: ("P1", True, 1), headers[1]: ("P1", True, 2), headers[2]: ("P3", True, 3), headers[3]: ("UVW/None", False, 4),
        headers[4]: ("", False, 4), headers[5]: ("", False, 4),
    }


def test_feedback_tables(spark):
    items = spark.createDataFrame([("Old Item",)], "item string")
    actions = spark.createDataFrame([("old  item", "New"), ("Other", "Other "), ("new", None)], "raw string, matched string")
    assert sorted(r.item.lower() for r in merges.append_ignored(items, actions).collect()) == ["new", "old item", "other"]
    log = spark.createDataFrame([("A", 1)], "original_text string, recorded_at long")
    new = spark.createDataFrame([(" a ", 2), ("b", 3), ("B", 4), ("", 5), ("", 6)], "original_text string, recorded_at long")
    assert sorted(r.recorded_at for r in merges.append_missing(log, new).collect()) == [1, 3, 5, 6]
    assert merges.truncated(log).count() == 0 and merges.truncated(log).columns == log.columns
