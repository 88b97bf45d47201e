"""Tables and text of pages that are given as positioned words.

A word is (path, page, text, x0, top, x1, bottom), with ``top`` growing down the page. Lines, tables and columns are runs
of words without a gap: along the page's height for lines and tables, along a table's width for columns. Spark brings a
page's words into one row, so they move once and are not sorted again for each step; a batch of such rows is then laid out
in arrays. Words that are null, blank or without finite edges count for nothing; words of equal place keep the order of
their text; extra columns are left out.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import SPACES

WORD = "struct<text: string, x0: double, top: double, x1: double, bottom: double>"
PAGE = ["path", "page"]
EDGES = ["x0", "top", "x1", "bottom"]
_SPACES = re.compile(b"(?:" + b"|".join(c.encode() for c in SPACES) + b")+")


@dataclass(frozen=True)
class Gaps:
    """Gaps in heights of the word after the gap: between middles of lines, between tables, between columns, and the
    largest one above a line that goes on with the row above."""

    line: float = 0.5
    table: float = 1.5
    column: float = 0.8
    wrap: float = 0.4


def gather(words: DataFrame) -> DataFrame:
    """(path, page, words): a row of each page, its words as an array of WORD."""
    word = F.struct(F.col("text").cast("string").alias("text"), *(F.col(c).cast("double").alias(c) for c in EDGES))
    return words.groupBy(*PAGE).agg(F.collect_list(word).alias("words"))


def _laid(pages: DataFrame, lay: Callable[[_Words], tuple[np.ndarray, dict]], found: str) -> DataFrame:
    """What ``lay`` makes of batches of pages: the page's row in the batch, of which path and page are taken, and columns."""
    kept = [pages.schema[c] for c in PAGE]
    schema = T.StructType([*kept, *T.StructType.fromDDL(found).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = _Words(batch.column("words"))
            if not len(words.page):
                continue
            with np.errstate(over="ignore", invalid="ignore"):
                page, columns = lay(words)
            at = pa.array(page)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in PAGE), *columns.values()], names=[*PAGE, *columns])

    return pages.select(*PAGE, F.sort_array("words").alias("words")).mapInArrow(run, schema)


class _Words:
    """Words of a batch's pages in arrays, by page and text, as the pages give them: every later sort is stable."""

    def __init__(self, held: pa.ListArray):
        page = np.repeat(np.arange(len(held)), pc.fill_null(held.value_lengths(), 0).to_numpy())
        given, *edges = held.flatten().flatten()
        text = _collapsed(given)
        edges = [e.to_numpy(zero_copy_only=False) for e in edges]  # null as NaN
        x0, top, x1, bottom = edges
        good = np.isfinite(edges).all(axis=0) & (x1 >= x0) & (bottom > top) & (pc.fill_null(pc.binary_length(text), 0).to_numpy() > 0)
        at = np.flatnonzero(good)
        if text is not given:  # the order was that of texts as given
            at = at[pc.sort_indices(pa.table({"page": page[at], "text": text.take(pa.array(at))}), [("page", "ascending"), ("text", "ascending")]).to_numpy()]
        self.page, self.text = page[at], text.take(pa.array(at))
        self.x0, self.top, self.x1, self.bottom = (e[at] for e in edges)

    def down(self, gaps: Gaps) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words from top to bottom, with the table and the line of each, both counted on through the batch."""
        mid = (self.top + self.bottom) / 2
        order = np.lexsort((self.x1, self.x0, mid, self.page))
        page, top, bottom, mid = (a[order] for a in (self.page, self.top, self.bottom, mid))
        table = _opens(page) | _over(top - _largest_before(bottom, page), (bottom - top) * gaps.table)
        line = table | _over(np.diff(mid, prepend=0.0), (bottom - top) * gaps.line)
        return order, np.cumsum(table) - 1, np.cumsum(line) - 1

    def joined(self, cell: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, pa.Array]:
        """Cells that hold words, rising, and their texts: words from left to right, lines from top to bottom."""
        order = np.lexsort((self.top, self.x1, self.x0, line, cell))
        cell, line = cell[order], line[order]
        first = _opens(cell)
        ends = np.flatnonzero(first | _opens(line))
        pieces = pc.binary_join(_lists(ends, self.text.take(pa.array(order))), " ")
        lines = np.flatnonzero(first[ends])
        return cell[first], pc.binary_join(_lists(lines, pieces), "\n")


def _collapsed(text: pa.Array) -> pa.Array:
    """``functions.text.collapse`` of texts, the same array where none changes. Most words are plain ASCII; bytes, as texts need not be valid."""
    odd = pc.fill_null(pc.match_substring_regex(text, "[^!-~]"), False)
    given = text.filter(odd).view(pa.binary()).to_pylist()
    clean = [_SPACES.sub(b" ", t).strip(b" ") for t in given]
    return text if clean == given else pc.replace_with_mask(text.view(pa.binary()), odd, pa.array(clean, pa.binary())).view(pa.string())


def _opens(run: np.ndarray) -> np.ndarray:
    """Whether each is the first of its run of equal values."""
    return np.diff(run, prepend=run[:1] - 1) != 0


def _over(gap: np.ndarray, least: np.ndarray) -> np.ndarray:
    """``gap > least`` as Spark compares: NaN, of edges whose sums are not finite, is the largest."""
    return ~(gap <= least)


def _largest_before(value: np.ndarray, run: np.ndarray) -> np.ndarray:
    """The largest value before each within its run, -inf at the run's first: spans of 1, 2, 4, ... values."""
    found = np.where(_opens(run), -np.inf, np.roll(value, 1))
    longest, span = int(np.diff(np.flatnonzero(np.append(_opens(run), True)), prepend=0).max(initial=0)), 1
    while span < longest:
        near = run[span:] == run[:-span]
        found[span:] = np.where(near, np.maximum(found[span:], found[:-span]), found[span:])
        span *= 2
    return found


def _lists(starts: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)), pa.int32()), values)


def page_text(words: DataFrame, gaps: Gaps = Gaps()) -> DataFrame:
    """(path, page, text): the lines of each page, one below the other."""
    return texts_of(gather(words), gaps)


def texts_of(pages: DataFrame, gaps: Gaps = Gaps()) -> DataFrame:
    """As ``page_text``, of pages (path, page, words)."""

    def lay(words: _Words) -> tuple[np.ndarray, dict]:
        order, _, lines = words.down(gaps)
        line = np.empty_like(lines)
        line[order] = lines
        page, text = words.joined(words.page, line)
        return page, {"text": text}

    return _laid(pages, lay, "text string")


def tables(words: DataFrame, gaps: Gaps = Gaps()) -> DataFrame:
    """(path, page, n, cells): each run of lines as rows of cells, n from 0 on each page.

    A table's columns are the runs of all its words along its width. A line close under the one above, with
    nothing in the first column, goes on with that row, cell by cell after a line end; a cell without words is null.
    """
    return tables_of(gather(words), gaps)


def tables_of(pages: DataFrame, gaps: Gaps = Gaps()) -> DataFrame:
    """As ``tables``, of pages (path, page, words)."""

    def lay(words: _Words) -> tuple[np.ndarray, dict]:
        order, table, line = words.down(gaps)
        page, x0, top, x1, bottom = (a[order] for a in (words.page, words.x0, words.top, words.x1, words.bottom))
        height, of_table, of_line = bottom - top, np.flatnonzero(_opens(table)), np.flatnonzero(_opens(line))

        across = np.lexsort((x1, x0, table))  # a table's words lie at the same places in both orders
        gap = _opens(table) | _over(x0[across] - _largest_before(x1[across], table), height[across] * gaps.column)
        column = np.cumsum(gap) - 1
        column -= column[of_table][table]
        at = np.empty_like(column)
        at[across] = column

        line_table, line_top, line_bottom = table[of_line], np.minimum.reduceat(top, of_line), np.maximum.reduceat(bottom, of_line)
        below = _over(line_top - np.roll(line_bottom, 1), np.maximum.reduceat(height, of_line) * gaps.wrap)
        new_row = _opens(line_table) | (np.minimum.reduceat(at, of_line) == 0) | below
        row_table = line_table[new_row]
        width = np.maximum.reduceat(at, of_table) + 1
        starts = np.concatenate([[0], np.cumsum(width[row_table])])  # of the rows' cells

        cell, lines = np.empty_like(at), np.empty_like(line)
        cell[order], lines[order] = starts[(np.cumsum(new_row) - 1)[line]] + at, line
        filled, texts = words.joined(cell, lines)
        where = np.full(starts[-1], -1)
        where[filled] = np.arange(len(filled))
        rows = _lists(starts[:-1], texts.take(pa.array(where, mask=where < 0)))
        table_page = page[of_table]
        n = np.arange(len(table_page))
        n -= np.maximum.accumulate(np.where(_opens(table_page), n, 0))
        return table_page, {"n": pa.array(n, pa.int32()), "cells": _lists(np.flatnonzero(_opens(row_table)), rows)}

    return _laid(pages, lay, "n int, cells array<array<string>>")
