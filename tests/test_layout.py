import random

from pyspark.sql import functions as F

from tallyloom.sources import invoices, layout

WORDS = "path string, page int, text string, x0 double, top double, x1 double, bottom double"


def word(text, x, y, path="a", page=0, high=10.0):
    return path, page, text, float(x), float(y), x + 5.0 * len(text), y + high


PAGE = [
    word("Invoice", 10, 10), word("7", 50, 10), word("To:", 10, 24), word("AB/C", 30, 24),
    word("#", 10, 60), word("Product", 40, 60), word("Unit", 200, 60), word("Price", 200, 71), word("Qty", 260, 60),
    word("1", 10, 90), word("Item", 40, 91), word("one", 65, 90.5), word("3.50", 200, 90), word("1,200", 260, 90),
    word("forte", 40, 102),
    word("2", 10, 122), word("Other", 40, 122), word("4", 260, 122),
    word("Total", 40, 140), word("1,204", 260, 140),
    word("Page", 10, 200), word("1", 35, 200),
]


def frame(spark, words):
    return spark.createDataFrame(words, WORDS)


def test_known_cells(spark):
    words = [*PAGE, *(word("x", 5 * i, 10, page=1) for i in range(0, 12, 4))]
    random.Random(3).shuffle(words)
    found = {(r.page, r.n): r.cells for r in layout.tables(frame(spark, words)).collect()}
    assert found[0, 0] == [["Invoice 7"], ["To: AB/C"]]
    assert found[0, 1] == [
        ["#", "Product", "Unit\nPrice", "Qty"], ["1", "Item one\nforte", "3.50", "1,200"], ["2", "Other", None, "4"], [None, "Total", None, "1,204"],
    ]
    assert found[0, 2] == [["Page 1"]] and found[1, 0] == [["x", "x", "x"]] and len(found) == 4
    rows = [tuple(r) for r in invoices.table_rows(layout.tables(frame(spark, words))).select("name", "quantity", "unit_price").orderBy("row").collect()]
    assert rows == [("Item one forte", 1200.0, 3.5), ("Other", 4.0, None)]


def test_text_of_a_page(spark):
    words = [*PAGE[:4], word("b", 10, 10, "b"), word("a", 10, 10, "b"), word("b", 10, 10, "b")]
    assert {r.path: r.text for r in layout.page_text(frame(spark, words)).collect()} == {"a": "Invoice 7\nTo: AB/C", "b": "a b b"}


def test_odd_words(spark):
    nan, inf = float("nan"), float("inf")
    odd = [("a", 0, None, 1.0, 1.0, 2.0, 2.0), ("a", 0, " \n ", 1.0, 1.0, 2.0, 2.0), ("a", 0, "x", None, 1.0, 2.0, 2.0), ("a", 0, "x", nan, 1.0, 2.0, 2.0),
           ("a", 0, "x", 1.0, inf, 2.0, inf), ("a", 0, "x", 1.0, 2.0, 2.0, 2.0), ("a", 0, "x", 3.0, 1.0, 2.0, 2.0)]
    assert layout.tables(frame(spark, odd)).count() == 0 and layout.page_text(frame(spark, [])).count() == 0
    extra = frame(spark, [*odd, word("y" * 100_000, 1, 1), word("z", 1, 30, None, None)]).withColumns({"line": F.lit("l"), "mid": F.lit("m"), "height": F.lit(0)})
    assert {(r.path, r.page, r.n, len(r.cells[0][0])) for r in layout.tables(extra).collect()} == {("a", 0, 0, 100_000), (None, None, 0, 1)}


def test_texts_are_cleaned_before_they_are_ordered(spark):
    places = [word("x", 10, 10)[3:]] * 5
    texts = [" b", "a\xa0\u2003 c ", "\tab", "\u3000", "é"]
    words = frame(spark, [("a", 0, t, *at) for t, at in zip(texts, places)] + [word("z", 10, 10, "b")])
    assert {r.path: r.text for r in layout.page_text(words).collect()} == {"a": "a c ab b é", "b": "z"}
    assert {r.path: r.cells for r in layout.tables(words).collect()} == {"a": [["a c ab b é"]], "b": [["z"]]}


def test_pages_of_many_batches(spark):
    """Pages of any length, in batches of any number, as one batch of all lays them out."""
    random.seed(9)
    words = [word(random.choice("ab") * random.randint(1, 3), random.randint(0, 40) * 5, random.randint(0, 30) * 4, f"p{p}", high=random.choice([8.0, 10.0])) for p in range(40) for _ in range(p * p % 70)]
    size, found = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before = spark.conf.get(size)
    for rows in ("1", "3", "10000"):
        spark.conf.set(size, rows)
        found.append(sorted(map(repr, layout.tables(frame(spark, words).repartition(3)).collect())))
    spark.conf.set(size, before)
    assert found[0] == found[1] == found[2] and len(found[0]) > 39


def test_a_grid_of_many_pages(spark):
    """Every cell of 60 pages of different shapes comes back, and the words move once."""
    random.seed(5)
    words, want = [], {}
    for p in range(60):
        columns, rows = random.randint(1, 6), random.randint(1, 25)
        cells = [[" ".join("w" * random.randint(1, 5) for _ in range(random.randint(0 if c else 1, 3))) or None for c in range(columns)] for _ in range(rows)]
        cells[0] = [x or "head" for x in cells[0]]
        want[f"p{p % 7}", p] = cells
        for i, row in enumerate(cells):
            for c, cell in enumerate(row):
                x = 10 + 150 * c
                for w in (cell or "").split():
                    words.append(word(w, x, 20 + 16 * i + random.random(), f"p{p % 7}", p))
                    x += 5 * len(w) + 3
    random.shuffle(words)
    found = layout.tables(frame(spark, words).repartition(5))
    assert {(r.path, r.page): r.cells for r in found.collect()} == want
    assert found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning") == 1


def test_import_by_words(spark):
    files = spark.createDataFrame([("a", b"table"), ("b", b"text"), ("c", b""), ("d", b"bad")], "path string, content binary")

    def extract(content):
        if content == b"bad":
            raise OSError("no file")
        pages = {b"table": [[w[2:] for w in PAGE]], b"text": [[w[2:] for w in PAGE[:4]], [("some", 1.0, 1.0, 9.0, 9.0), ("item", 10.0, 1.0, 19.0, 9.0)]]}
        return pages.get(content, [])

    got = invoices.read_words(files, extract)
    assert {(r.path, r.name, r.quantity, r.unit_price) for r in got.rows.collect()} == {
        ("a", "Item one forte", 1200.0, 3.5), ("a", "Other", 4.0, None), ("b", "some item", None, None),
    }
    assert {r.path: r.error for r in got.failed.collect()} == {"c": "no rows", "d": "OSError: no file"} and (got.pages, got.errors) == (3, 1)
