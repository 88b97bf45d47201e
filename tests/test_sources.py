import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import text
from tallyloom.operators import lookups
from tallyloom.sources import invoices, tables
from tallyloom.streaming.files import LINES, match_stream
from tallyloom.plans.cascade import Dimensions
from tallyloom.staging import checkpoint_dir

SHEET = """<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{}</sheetData></worksheet>"""


def xlsx(path, rows):
    cells = "".join(
        f'<row r="{i}">' + "".join(f'<c r="{chr(65 + j)}{i}" t="inlineStr"><is><t>{v}</t></is></c>' for j, v in enumerate(row) if v is not None) + "</row>"
        for i, row in enumerate(rows, 1)
    )
    with zipfile.ZipFile(path, "w") as out:
        out.writestr("xl/worksheets/sheet1.xml", SHEET.format(cells))


def test_catalog_readers(spark, tmp_path):
    xlsx(tmp_path / "c.xlsx", [["صنف", "كود", "سعر"], ["name one", "1", "2.5"], ["name two", None, "x"]])
    (tmp_path / "c.csv").write_text("Product,code,Price\nname one,1,2.5\n")
    got = [tuple(r) for r in tables.read_catalog(spark, str(tmp_path / "c.xlsx")).orderBy("idx").collect()]
    assert got == [(0, "1", "name one", 2.5), (1, None, "name two", None)]
    assert tables.read_catalog(spark, str(tmp_path / "c.csv")).first().name == "name one"
    assert tables.read_catalog(spark, str(tmp_path / "none.csv")).count() == 0
    (tmp_path / "bad.csv").write_text("code,Price\n1,2.5\n")
    with pytest.raises(ValueError):
        tables.read_catalog(spark, str(tmp_path / "bad.csv"))


def test_a_long_sheet_is_read_by_a_task(spark, tmp_path):
    """300,000 rows with shared strings: the driver gets a header and a width, and rows keep their order."""
    path, n = tmp_path / "long.xlsx", 300_000
    shared = "".join(f"<si><r><t>na</t></r><r><t>me {i}</t></r></si>" for i in range(100))
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        out.writestr("xl/sharedStrings.xml", f'<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">{shared}</sst>')
        with out.open("xl/worksheets/sheet1.xml", "w") as sheet:
            sheet.write(SHEET.split("{}")[0].encode() + b'<row r="1"><c r="A1" t="inlineStr"><is><t>Product</t></is></c><c r="B1" t="inlineStr"><is><t>code</t></is></c></row>')
            for i in range(n):
                sheet.write(f'<row r="{i + 2}"><c r="A{i + 2}" t="s"><v>{i % 100}</v></c><c r="B{i + 2}"><v>{i}</v></c></row>'.encode())
            sheet.write(SHEET.split("{}")[1].encode())
    rows = tables.read_catalog(spark, str(path))
    assert rows.where("name = concat('name ', idx % 100) and code = cast(idx as string)").count() == rows.count() == n
    assert tuple(rows.agg(F.min("idx"), F.max("idx"), F.count_distinct("idx")).first()) == (0, n - 1, n)


def test_odd_sheets(spark, tmp_path):
    xlsx(tmp_path / "odd.xlsx", [["name", None, " name ", ""], ["a", "b", "c", "d", "e"], [None, "x"]])
    rows = tables.read(spark, str(tmp_path / "odd.xlsx")).orderBy("idx")
    assert rows.columns == ["name", "_c1", "name_2", "_c3", "_c4", "idx"]
    assert [tuple(r) for r in rows.collect()] == [("a", "b", "c", "d", "e", 0), (None, "x", None, None, None, 1)]
    xlsx(tmp_path / "none.xlsx", [])
    assert tables.read(spark, str(tmp_path / "none.xlsx")).columns == ["idx"] and tables.read(spark, str(tmp_path / "none.xlsx")).count() == 0
    with zipfile.ZipFile(tmp_path / "gap.xlsx", "w") as out:
        out.writestr("xl/worksheets/sheet1.xml", SHEET.format('<row r="1"><c r="A1"><v>1</v></c></row><row r="4"><c r="B4"><v>2</v></c></row>'))
    assert [tuple(r) for r in tables.read(spark, str(tmp_path / "gap.xlsx"), header=False).orderBy("idx").collect()] == [("1", None, 0), (None, None, 1), (None, None, 2), (None, "2", 3)]


def test_controlled_sheet(spark, tmp_path):
    xlsx(tmp_path / "l.xlsx", [["title"], [None], ["1", "اسم الصنف"], ["2", "دواء"]])
    assert [r.name for r in tables.controlled_sheet(tables.read(spark, str(tmp_path / "l.xlsx"), header=False)).collect()] == ["اسم الصنف", "دواء"]


def test_replace_a_table_that_is_read(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path)
    tables.replace_table(spark.read.parquet(path).where("id > 0"), path)
    assert spark.read.parquet(path).count() == 2


def test_tables_before_text(spark):
    cells = [["#", "Product\nName", "Qty", "Unit\nPrice"], ["1", " Item  one ", "1,200", "EGP 3.50"], ["2", "Total", "1", "9"], ["3", None, "1", "1"]]
    found = spark.createDataFrame([("a", 0, 0, cells), ("b", 0, 0, [["x"], ["y"]])], invoices.TABLES)
    pages = spark.createDataFrame([("a", 0, "ignored line"), ("b", 0, "To: AB/C # Code Product\nsome item\nPage 1\n12 34\n")], "path string, page int, text string")
    rows = {(r.path, r.name, r.quantity, r.unit_price) for r in invoices.item_rows(found, pages).collect()}
    assert rows == {("a", "Item one", 1200.0, 3.5), ("b", "To: AB/C # Code Product", None, None), ("b", "some item", None, None)}
    assert {r.path: r.header for r in invoices.header_text(pages).collect()}["b"] == "To: AB/C "


def test_files_are_read_once_and_fail_alone(spark, tmp_path):
    for name, content in (("b.PDF", b"good"), ("a.pdf", b"bad"), ("c.txt", b"good"), ("d.pdf", b"empty"), ("e.pdf", b"blank")):
        (tmp_path / name).write_bytes(content)
    assert [r.path.rsplit("/", 1)[1] for r in invoices.list_files(spark, str(tmp_path)).collect()] == ["a.pdf", "b.PDF", "d.pdf", "e.pdf"]
    calls = spark.sparkContext.accumulator(0)

    def extract(content):
        calls.add(1)
        if content == b"bad":
            raise ValueError("no pages")
        return {b"empty": [], b"blank": [([], "Page 1"), ([], None)]}.get(content) or [([[["Product"], ["item"]]], "To: AB/C # Code Product")] if content != b"empty" else []

    got = invoices.read_files(invoices.contents(spark, str(tmp_path)), extract)
    assert [r.name for r in got.rows.collect()] == ["item"] and [r.header for r in got.headers.collect()] == ["To: AB/C "]
    assert {r.path.rsplit("/", 1)[1]: r.error for r in got.failed.collect()} == {"a.pdf": "ValueError: no pages", "d.pdf": "no rows", "e.pdf": "no rows"}
    assert (got.pages, got.errors, calls.value) == (3, 1, 4)


def test_rows_keep_the_order_of_their_files(spark, tmp_path):
    want = []
    for f in range(7):
        lines = [f"name {f % 3} {i % 5},{f * 100 + i}" for i in range((f * 13) % 40)]
        (tmp_path / f"{f}.csv").write_text("Product,code\n" + "".join(x + "\n" for x in lines))
        want += [tuple(x.split(",")) for x in lines]
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        rows = tables.catalog(tables.numbered(spark.read.csv(str(tmp_path), header=True)))
        assert [(r.name, r.code) for r in rows.orderBy("idx").collect()] == want
        assert [r.idx for r in rows.select("idx").orderBy("idx").collect()] == list(range(len(want)))
        first, last = {}, {}
        for i, (name, _) in enumerate(want):
            first.setdefault(name, i)
            last[name] = i
        assert {r.name: r.idx for r in lookups.by_name(rows).collect()} == first
        assert {r["name"]: r.idx for r in lookups.last_wins(rows, "name", "idx").collect()} == last
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_dimensions_by_header(spark, tmp_path):
    (tmp_path / "m.csv").write_text("Odoo Name,arabic_code\n Key ,1\nkey,2\n,3\nother,\n")
    (tmp_path / "o.csv").write_text("Odoo_Raw_Name,Mapped_Arabic_Name\na,x\nA ,y\n ,z\nb, \n")
    (tmp_path / "i.csv").write_text("Item_Name\nsame\nsame\n")
    read = lambda name, headers: tables.read_dimension(spark, str(tmp_path / name), headers)
    assert {(r.key, r.code) for r in lookups.reference_map(read("m.csv", tables.MAP_HEADERS)).collect()} == {("KEY", "2")}
    assert {(r.key, r.mapped) for r in lookups.overrides(read("o.csv", tables.OVERRIDE_HEADERS)).collect()} == {("a", "y")}
    assert [r.item for r in read("i.csv", tables.IGNORE_HEADERS).collect()] == ["same", "same"]
    assert read("none.csv", tables.IGNORE_HEADERS).columns == ["item", "version"]
    (tmp_path / "bad.xlsx").write_bytes(b"no sheet")
    assert tables.read_dimension(spark, str(tmp_path / "bad.xlsx"), tables.MAP_HEADERS, on_error="empty").count() == 0


def test_folded_keys_equal_case_folding(spark):
    letters = [chr(c) for r in ((0x41, 0x250), (0x370, 0x400), (0x400, 0x530), (0x600, 0x700), (0x1E00, 0x1F00)) for c in range(*r) if chr(c).isalpha()]
    rows = spark.createDataFrame([(c + "a",) for c in letters], "x string").select("x", text.key_folded(F.col("x")).alias("k")).collect()
    assert [r.x for r in rows if r.k != r.x.casefold()] == ["ıa"]


def test_stream_of_line_files(spark, tmp_path):
    catalog = spark.createDataFrame([(0, "A", "اسم", 1.0)], "idx long, code string, name string, price double")
    spark.createDataFrame([("i", 1, "اسم", 1.0, 1.0)], LINES).write.parquet(str(tmp_path / "in"))
    match_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), Dimensions(catalog)).awaitTermination()
    assert [(r.pos, r.source) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(1, "database")]
    held = Path(checkpoint_dir(spark)) / "tallyloom"
    before = set(held.iterdir()) if held.exists() else set()
    spark.createDataFrame([("i", 2, "اسمم", 1.0, 1.0)], LINES).write.mode("append").parquet(str(tmp_path / "in"))
    match_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), Dimensions(catalog)).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    assert set(held.iterdir()) <= before  # batches leave nothing behind
