import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.functions import features, lexicon, similarity, text, translit
from tallyloom.operators.similar import Keys

CLEANED = [
    ("Panadol Extra 500mg Tab", "Panadol Extra Tab", ["500mg"], ["500 مجم"]),
    ("  Free Sample Cough  Syrup ", "Cough Syrup", [], []),
    ("BEPRA 20MG 28 F.C. TAB.", "BEPRA 28 TAB", ["20MG"], ["20 مجم"]),
    ("GLIMET FORTE 5/800 MG 30 TAB", "GLIMET FORTE 5 30 TAB", ["800 MG"], ["800 مجم"]),
    ("Cream 5 % 30 gm", "Cream", ["5 %", "30 gm"], ["5 %", "30 جم"]),
    ("Vit D 1000 IU 50 mcg", "Vit D", ["1000 IU", "50 mcg"], ["1000 وحدة دولية", "50 ميكروجرام"]),
    ("Eye drops 0.5% N.P 10ml", "drops", ["0.5%", "10ml"], ["0.5%", "10 مل"]),
    ("", "", [], []),
]


def test_clean_line_goldens(spark):
    rows = spark.createDataFrame([(r[0],) for r in CLEANED], "raw string").select("raw", text.clean_line(F.col("raw")).alias("c")).collect()
    assert [(r.raw, r.c.core_text, r.c.extracted_units, r.c.extracted_units_ar) for r in rows] == CLEANED


def test_words_of_both_scripts(spark):
    cases = [("Schiff", "سشيفف"), ("Insulin", "اينسولين"), ("Theo", "ثيو"), ("ecce", "اييسي")]
    rows = spark.createDataFrame([(a,) for a, _ in cases], "w string").select(translit.transliterate_word(F.col("w")).alias("x")).collect()
    assert rows[0].x == cases[0][1] and rows[2].x == cases[2][1]
    arabic = spark.createDataFrame([("اب ab",), ("ابت ab",), ("",), (None,)], "t string").select(text.is_arabic(F.col("t")).alias("x")).collect()
    assert [r.x for r in arabic] == [False, True, False, False]


def test_article_and_phrases_take_two_tokens(spark):
    rows = spark.createDataFrame([("el tab sugar free el",)], "t string").select(lexicon.lexical_map(F.col("t")).alias("x")).first()
    assert [(p.kind, p.value) for p in rows.x] == [("ar", "التاب"), ("ar", "خالي من السكر"), ("en", "el")]


def test_features(spark):
    rows = spark.createDataFrame([("50 مجم",), ("كتافلام 1.5 مجم اقراص",), (None,)], "t string").select(
        features.core_tokens(F.col("t")).alias("c"), features.numbers(F.col("t")).alias("n"), features.anchor(F.col("t")).alias("a")
    ).collect()
    assert [(r.c, r.n, r.a) for r in rows] == [(["50", "مجم"], ["50"], "مجم"), (["كتافلام", "1.5", "اقراص"], ["1", "5"], "كتافلام"), ([], [], None)]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_both_scorers_equal_the_dynamic_programme(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdم ") for _ in range(n))
    pairs = [(word(rng.choice([0, 1, 20, 62, 63, 64, 65, 130])), word(rng.choice([0, 2, 30, 64, 90]))) for _ in range(60)]
    want = [200.0 * lcs(a, b) / (len(a) + len(b)) if a or b else 100.0 for a, b in pairs]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    got = [r.x for r in rows.select("i", similarity.ratio(F.col("a"), F.col("b")).alias("x")).orderBy("i").collect()]
    assert got == pytest.approx(want)
    texts, i = [a for a, _ in pairs], np.arange(len(pairs))
    keys = Keys([b for _, b in pairs])
    assert list(keys.ratios(texts, i, i)) == pytest.approx(want)
