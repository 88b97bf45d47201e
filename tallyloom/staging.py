"""Cutting lineage: tables that later steps read more than once are written to the shared folder.

``stage`` writes a table, ``staging`` is a scope whose tables go at its end, ``outlive`` hands a
table to the scope around it and ``unstage`` deletes one early. Scopes belong to a thread (or
task), so one query's end never deletes another's tables.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("tallyloom_scopes", default=())
_lock, _writers, _before = threading.Lock(), 0, None


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder every executor shares. Where none is set, a private one in local mode; a cluster must name one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="tallyloom-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


@contextmanager
def _no_shuffle_files(spark: SparkSession) -> Iterator[None]:
    """Writes inside delete their shuffle files at their end; the session's own setting comes back after the last."""
    global _writers, _before
    with _lock:
        if not _writers:
            _before = spark.conf.get(CLEANUP, None)
            spark.conf.set(CLEANUP, "true")
        _writers += 1
    try:
        yield
    finally:
        with _lock:
            _writers -= 1
            if not _writers:
                spark.conf.unset(CLEANUP) if _before is None else spark.conf.set(CLEANUP, _before)


def stage(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back: lineage ends here.

    The reader gets the writer's schema, so an empty table keeps its columns. ``by`` names a column
    whose values get folders of their own; it then comes last. Inside ``staging`` the table is
    deleted at the scope's end.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/tallyloom/{name}-{uuid.uuid4().hex}"
    with _no_shuffle_files(spark):
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    if scopes := _scopes.get():
        scopes[-1].append(path)
    schema = df.select(*(c for c in df.columns if c != by), by).schema if by else df.schema
    return spark.read.schema(schema).parquet(path)


@contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """Tables staged inside are deleted at the end, but for those given to ``outlive``."""
    made: list[str] = []
    token = _scopes.set((*_scopes.get(), made))
    try:
        yield
    finally:
        _scopes.reset(token)
        for path in made:
            _delete(spark, path)


def outlive(df: DataFrame) -> DataFrame:
    """Keep a staged table beyond the innermost scope: the one around it, if any, deletes it."""
    scopes = _scopes.get()
    for path in _folders(df):
        for depth, made in enumerate(scopes):
            if path in made:
                made.remove(path)
                if depth:
                    scopes[depth - 1].append(path)
                break
    return df


def unstage(df: DataFrame) -> None:
    """Delete the files of a staged table that no later step reads."""
    for path in _folders(df):
        _delete(df.sparkSession, path)
        for made in _scopes.get():
            if path in made:
                made.remove(path)


def _folders(df: DataFrame) -> set[str]:
    """The staged folders that ``df`` reads, as they were named when written."""
    names = {f.rsplit("/tallyloom/", 1)[1].split("/", 1)[0] for f in df.inputFiles() if "/tallyloom/" in f}
    return {f"{checkpoint_dir(df.sparkSession)}/tallyloom/{name}" for name in names}


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
