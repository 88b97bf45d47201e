"""Invoice rows from tables of cells, or from text where a file has no table.

Taking tables and text out of a PDF is a plug-in: ``extract(bytes)`` gives pages as
(tables, text). What follows is relational.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.text import SPACES, collapse, let, parse_number, strip
from ..staging import stage
from . import layout

# Words that name columns, footers, and lines that are no products.
PRODUCT_HINTS = ["product"]
PRICE_HINTS = ["unit price", "price", "سعر"]
QUANTITY_HINTS = ["quantity", "qty", "الكمية", "كمية"]
FOOTER_NAMES = ["total", "grand total", "subtotal", "إجمالي", "الإجمالي", "المجموع"]
NO_PRODUCT_HINTS = ["invoice", "فاتورة", "page", "صفحة", "total", "إجمالي", "odoo", "date", "تاريخ", "customer", "عميل"]

TABLES = "path string, page int, n int, cells array<array<string>>"


def header_cell(cell: Column) -> Column:
    return F.lower(collapse(F.coalesce(cell, F.lit(""))))


def find_columns(header: Column, kinds: dict[str, list[str]]) -> Column:
    """struct: for each kind the index of the first header cell that contains one of its hints, or null. Cells are
    normalised once for all kinds, and only lower-cased where no hint that counts has white space within."""
    # A hint that contains another one finds no more than that one.
    least = {name: [h for h in hints if not any(o in h for o in hints if o != h)] for name, hints in kinds.items()}
    spaced = any(c in SPACES for hints in least.values() for h in hints for c in h)

    def first(cells: Column, hints: list[str]) -> Column:
        hit = lambda cell: reduce(or_, (F.contains(cell, F.lit(h)) for h in hints))
        return F.nullif(F.array_position(F.transform(cells, hit), F.lit(True)), F.lit(0)).cast("int") - 1

    return let(F.transform(header, header_cell if spaced else F.lower), lambda cells: F.struct(*(first(cells, hints).alias(name) for name, hints in least.items())))


def find_column(header: Column, hints: list[str]) -> Column:
    """Index of the first header cell that contains a hint, or null."""
    return find_columns(header, {"at": hints})["at"]


def footer_filter(rows: DataFrame, name: str = "name") -> DataFrame:
    return rows.where(~F.lower(strip(F.col(name))).isin(FOOTER_NAMES))


def table_rows(tables: DataFrame) -> DataFrame:
    """(path, page, n, row, name, quantity, unit_price) of tables (path, page, n, cells) with a
    product column and a row below their header."""
    head = F.col("cells")[0]
    kinds = find_columns(head, {"p": PRODUCT_HINTS, "u": PRICE_HINTS, "q": QUANTITY_HINTS})
    found = tables.where(F.size("cells") >= 2).select("path", "page", "n", "cells", kinds.alias("at")).select("path", "page", "n", "cells", "at.*")
    rows = found.where("p is not null").select("path", "page", "n", "p", "u", "q", F.posexplode("cells").alias("row", "cell")).where("row > 0")
    rows = rows.select(
        "path", "page", "n", "row", collapse(F.get("cell", F.col("p"))).alias("name"),
        parse_number(F.get("cell", F.col("q"))).alias("quantity"), parse_number(F.get("cell", F.col("u"))).alias("unit_price"),
    )
    return rows.where("name <> ''").where(~F.lower("name").isin(FOOTER_NAMES))  # collapsed, so nothing to strip


def text_rows(pages: DataFrame) -> DataFrame:
    """(path, page, row, name) of the lines of pages (path, page, text) that may be products."""
    lines = pages.select("path", "page", F.posexplode(F.split("text", r"\r\n|[\n\r]")).alias("row", "line"))
    lines = lines.select("path", "page", "row", strip(F.col("line")).alias("name")).where("name <> ''")
    lines = lines.where(~F.lower("name").rlike("|".join(NO_PRODUCT_HINTS)))
    return lines.where(F.col("name").rlike("[A-Za-z؀-ۿ]{3,}"))


def item_rows(tables: DataFrame, pages: DataFrame) -> DataFrame:
    """(path, page, n, row, name, quantity, unit_price): of a file's tables, or else of its text."""
    of_tables = table_rows(tables)
    # Pages go before their text is cut up: by path, as tables and pages that come from one grouping lie already.
    rest = text_rows(pages.join(of_tables.select("path").distinct(), "path", "left_anti"))
    none = F.lit(None).cast("double")
    return of_tables.unionByName(rest.select("path", "page", F.lit(0).alias("n"), "row", "name", none.alias("quantity"), none.alias("unit_price")))


def header_text(pages: DataFrame) -> DataFrame:
    """(path, header): the text of each first page before its table's head."""
    return pages.where("page = 0").select("path", F.split(F.coalesce("text", F.lit("")), r"(?i)#\s*Code\s*Product", 2)[0].alias("header"))


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path) of a folder's own .pdf files, by path; their contents are not read."""
    return contents(spark, folder).select("path").orderBy("path")


def contents(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of a folder's own .pdf files, in any order."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").load(folder).select("path", "content")


@dataclass
class Imported:
    """rows (path, page, n, row, name, quantity, unit_price), headers (path, header), failed (path, error) and how many of each."""

    rows: DataFrame
    headers: DataFrame
    failed: DataFrame
    pages: int
    errors: int


def read_files(files: DataFrame, extract: Callable[[bytes], list[tuple[list, str]]]) -> Imported:
    """What ``extract`` finds in files (path, content), each read once.

    The pass over the files stages their pages and errors, and counts both on its way. A file that cannot be read, and
    one without a row, is in ``failed`` alone; the others go on.
    """
    read, seen = _extracted(files, extract, "struct<tables: array<array<array<string>>>, text: string>")
    fine = read.where("page is not null").select("path", "page", "found.*")
    return _imported(read, fine.select("path", "page", F.posexplode("tables").alias("n", "cells")), fine.select("path", "page", "text"), seen)


def read_words(files: DataFrame, extract: Callable[[bytes], list[list[tuple]]], gaps: layout.Gaps = layout.Gaps()) -> Imported:
    """As ``read_files``, where ``extract`` gives each page as words (text, x0, top, x1, bottom): tables and text are
    rebuilt from where the words stand."""
    read, seen = _extracted(files, extract, f"array<{layout.WORD}>")
    words = read.where("page is not null").select("path", "page", F.explode("found").alias("word")).select("path", "page", "word.*")
    tables, pages = stage(layout.tables(words, gaps), "tables"), stage(layout.page_text(words, gaps), "texts")
    return _imported(read, tables, pages, seen)


def _extracted(files: DataFrame, extract: Callable[[bytes], list], kind: str) -> tuple[DataFrame, Observation]:
    """(path, page, found, error), staged, of one pass over the files; a file without pages has one row without any."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            out = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    out += [(path, i, page, None) for i, page in enumerate(extract(content))] or [(path, None, None, None)]
                except Exception as e:  # told in the table of failures
                    out.append((path, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["path", "page", "found", "error"])

    seen = Observation()
    read = files.select("path", "content").mapInPandas(run, f"path string, page int, found {kind}, error string")
    return stage(read.observe(seen, F.count("page").alias("pages"), F.count("error").alias("errors")), "pages"), seen


def _imported(read: DataFrame, tables: DataFrame, pages: DataFrame, seen: Observation) -> Imported:
    rows = stage(item_rows(tables, pages), "rows")
    empty = read.where("error is null").select("path").distinct().join(rows.select("path"), "path", "left_anti")
    failed = read.where("error is not null").select("path", "error").union(empty.select("path", F.lit("no rows").alias("error")))
    headers = header_text(pages).join(rows.select("path"), "path", "left_semi")
    return Imported(rows, headers, failed, seen.get["pages"], seen.get["errors"])
