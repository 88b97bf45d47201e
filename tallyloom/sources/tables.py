"""Dimension tables: headers by alias, Excel or CSV or Parquet, and sinks that replace a table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import collapse
from ..staging import stage
from .xlsx import read_xlsx

# Headers under which each column may stand.
CATALOG_HEADERS = {"code": ["كود", "code"], "name": ["صنف", "name", "product"], "price": ["سعر", "price"]}
MAP_HEADERS = {"english": ["المقابل الإنجليزي", "english", "Odoo Name"], "code": ["الكود (عربي)", "arabic_code"]}
OVERRIDE_HEADERS = {"raw": ["Odoo_Raw_Name"], "mapped": ["Mapped_Arabic_Name"]}
IGNORE_HEADERS = {"item": ["Item_Name"]}
MISSING_HEADERS = {
    "recorded_at": ["التاريخ"], "party": ["الصيدلية"], "invoice": ["اسم الفاتورة"], "original_text": ["الاسم الأصلي (Odoo)"],
    "suggested": ["الاسم العربي المقترح"], "invoice_price": ["سعر الفاتورة"], "quantity": ["الكمية"],
}


def exists(spark: SparkSession, path: str) -> bool:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()).exists(found)


def read(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """A table of strings (but for Parquet) with ``idx``, the order of its rows over its files by path."""
    low = path.lower()
    if low.endswith(".xlsx"):
        return read_xlsx(spark, path, header)
    if low.endswith(".csv"):
        rows = spark.read.csv(path, header=header)
    elif low.endswith(".parquet"):
        rows = spark.read.parquet(path)
    else:
        raise ValueError(f"no reader for {path}")
    return rows if "idx" in rows.columns else numbered(rows)


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` of files with ``idx``: 0, 1, ... by path and, within a file, from its beginning.

    Spark packs splits of files into partitions by size, so partitions do not follow files. Rows are staged with the
    split that they came from, splits are counted, and a split's rows follow on all that come before it.
    """
    place = [F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__start")]
    held = stage(rows.select("*", *place, F.monotonically_increasing_id().alias("__at")), "numbered")
    splits = held.groupBy("__file", "__start").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    before = Window.orderBy("__file", "__start").rowsBetween(Window.unboundedPreceding, -1)  # a row a split
    splits = splits.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    found = held.join(splits.drop("__n"), ["__file", "__start"])
    return found.select(*(f"`{c}`" for c in rows.columns), (F.col("__before") + F.col("__at") - F.col("__first")).alias("idx"))


def aliased(rows: DataFrame, headers: dict[str, list[str]], required: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with the columns named by ``headers``, null where no alias is there; others stay."""
    found = {}
    for name, aliases in headers.items():
        known = {a.strip().lower() for a in aliases}
        found[name] = next((c for c in rows.columns if c.strip().lower() in known), None)
    if missing := [n for n in required if not found[n]]:
        raise ValueError(f"no column for {', '.join(missing)} among {', '.join(rows.columns)}")
    named = [(F.col(f"`{c}`") if c else F.lit(None).cast("string")).alias(n) for n, c in found.items()]
    return rows.select(*named, *(f"`{c}`" for c in rows.columns if c not in found.values() and c not in found))


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """(idx, code, name, price): a name is required; a path that is not there gives no rows."""
    if not path or not exists(spark, path):
        return spark.createDataFrame([], "idx long, code string, name string, price double")
    return catalog(read(spark, path))


def catalog(rows: DataFrame) -> DataFrame:
    named = aliased(rows, CATALOG_HEADERS, required=("name",))
    return named.select(
        F.col("idx").cast("long").alias("idx"), F.col("code").cast("string").alias("code"), F.col("name").cast("string").alias("name"), F.col("price").try_cast("double").alias("price")
    )


def read_dimension(spark: SparkSession, path: str, headers: dict[str, list[str]], on_error: str = "raise") -> DataFrame:
    """A dimension by its headers, with ``version`` (the order of rows). ``on_error="empty"``
    gives no rows for a file that cannot be read."""
    try:
        if exists(spark, path):
            return aliased(read(spark, path), headers).select(*headers, F.col("idx").alias("version"))
    except Exception:
        if on_error != "empty":
            raise
    return spark.createDataFrame([], ", ".join(f"{c} string" for c in headers) + ", version long")


def controlled_sheet(rows: DataFrame) -> DataFrame:
    """(name) of a sheet without headers: its second column, or the first if it is alone."""
    columns = [c for c in rows.columns if c != "idx"]
    name = F.col(f"`{columns[1] if len(columns) > 1 else columns[0]}`")
    return rows.where(name.isNotNull()).select(name.cast("string").alias("name"))


def missing_log(rows: DataFrame) -> DataFrame:
    """The log's columns, absent ones empty."""
    named = aliased(rows, MISSING_HEADERS)
    return named.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in MISSING_HEADERS))


def replace_table(rows: DataFrame, path: str) -> None:
    """Write beside ``path`` and swap: the table may be one that ``rows`` reads."""
    spark = rows.sparkSession
    new, old = (f"{path.rstrip('/')}.{kind}-{uuid.uuid4().hex}" for kind in ("new", "old"))
    rows.write.parquet(new)
    jvm = spark._jvm
    target, fresh, aside = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, new, old))
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(target) and not fs.rename(target, aside):
        raise OSError(f"cannot move {path} aside")
    if not fs.rename(fresh, target):
        fs.rename(aside, target)
        raise OSError(f"cannot replace {path}")
    fs.delete(aside, True)


def key_collapsed(column: str):
    return collapse(F.col(column))
