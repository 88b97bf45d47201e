"""Sheets of .xlsx files over the standard library (zip and XML), read on executors through Spark's file system.

A sheet is one deflate stream, which cannot be entered in its middle, so a file is one task, which walks the stream row by
row; the format ends at 1,048,576 rows. Its rows are staged once, and what follows reads them in splits.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..staging import stage

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_ROWS = 8192  # rows that a task hands over at a time


def sheet_rows(data: bytes) -> Iterator[list[str | None]]:
    """Cells of the first sheet as text, row by row; blank cells are null, rows that the sheet leaves out are empty."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        names, shared = book.namelist(), []
        if "xl/sharedStrings.xml" in names:
            with book.open("xl/sharedStrings.xml") as stream:
                shared = ["".join(t.text or "" for t in item.iter(f"{_MAIN}t")) for item in _elements(stream, "si")]
        sheet = min((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
        with book.open(sheet) as stream:
            count = 0
            for row in _elements(stream, "row"):
                for _ in range(int(row.get("r", count + 1)) - count - 1):
                    count += 1
                    yield []
                cells: list[str | None] = []
                for cell in row.iter(f"{_MAIN}c"):
                    at = _column(cell.get("r", "")) if cell.get("r") else len(cells)
                    cells += [None] * (at - len(cells) + 1)
                    cells[at] = _value(cell, shared)
                count += 1
                yield cells


def _elements(stream, name: str) -> Iterator[ElementTree.Element]:
    """Elements as they end; what has been read is let go."""
    walk = ElementTree.iterparse(stream, ("start", "end"))
    parents = []
    for event, element in walk:
        if event == "start":
            parents.append(element)
            continue
        parents.pop()
        if element.tag == f"{_MAIN}{name}":
            yield element
            parents[-1].remove(element)


def _column(reference: str) -> int:
    n = 0
    for c in re.match("[A-Z]*", reference)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def _value(cell, shared: list[str]) -> str | None:
    kind, value = cell.get("t"), cell.find(f"{_MAIN}v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{_MAIN}t")) or None
    if value is None or value.text is None:
        return None
    return shared[int(value.text)] if kind == "s" else value.text


def read_xlsx(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """The first sheet as strings, with ``idx`` from 0. A header without a text, or with one that stands before, is numbered."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            for content in batch["content"]:
                held, first = [], 0
                for row in sheet_rows(content):
                    held.append(row)
                    if len(held) == _ROWS:
                        yield pd.DataFrame({"n": range(first, first + len(held)), "cells": held})
                        held, first = [], first + len(held)
                if held:
                    yield pd.DataFrame({"n": range(first, first + len(held)), "cells": held})

    seen = Observation()
    found = spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "n long, cells array<string>")
    rows = stage(found.observe(seen, F.max(F.size("cells")).alias("width")), "sheet")
    names = [f"_c{i}" for i in range(seen.get["width"] or 0)]
    if header:
        top = rows.where("n = 0").first()
        for i, name in enumerate(top.cells if top else []):
            name = (name or "").strip()
            names[i] = f"{name}_{i}" if name in names[:i] else name or names[i]
        rows = rows.where("n > 0").withColumn("n", F.col("n") - 1)
    return rows.select(*(F.get("cells", F.lit(i)).alias(name) for i, name in enumerate(names)), F.col("n").alias("idx"))
