"""Dimension tables in versions: a change rewrites the buckets of keys that it touches, and no others.

A table's folder holds ``data/<id>/__bucket=<n>``, Parquet that is never changed, and ``versions/<number>.json``, which
names the folder of each bucket. The largest number is the table as it is. A writer puts the next number there if no one
else has, and else merges anew into what the other wrote (only if both touched a bucket). Readers always find a whole
version; a write that dies leaves files that no version names, until ``drop_before`` deletes them.

Putting a number once needs a file system whose rename does not replace (HDFS) or that has links (local); on object stores
it needs a committer that gives the same.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..staging import stage, staging

# Tries of a save and seconds of the first wait; each wait is longer by as much.
TRIES, WAIT = 5, 0.4


@dataclass(frozen=True)
class Version:
    """``folders`` maps buckets to folders of ``data``, ``applied`` a stream's name to its last batch. With ``spread``,
    rows of a blank or null key lie in any bucket, by all their columns."""

    number: int
    key: str
    buckets: int
    spread: bool
    schema: str
    folders: dict[str, str] = field(default_factory=dict)
    applied: dict[str, int] = field(default_factory=dict)

    @property
    def columns(self) -> list[Column]:
        """The table's columns, of rows that may have others or other types."""
        return [F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in self.fields()]

    def fields(self) -> StructType:
        return StructType.fromJson(json.loads(self.schema))

    def bucket(self) -> Column:
        """The bucket of a row that has the table's columns; of ``changes`` the key is enough but for ``spread``."""
        key = F.col(f"`{self.key}`").cast(self.fields()[self.key].dataType).cast("string")
        code = F.xxhash64(key)
        if self.spread:
            code = F.when(F.trim(F.coalesce(key, F.lit(""))) == "", F.xxhash64(*self.columns)).otherwise(code)
        return F.pmod(code, F.lit(self.buckets)).cast("string")


def create(rows: DataFrame, path: str, key: str, buckets: int = 64, spread: bool = False) -> Version:
    """Write ``rows`` as the first version of a table; a table that is there already is an error."""
    first = Version(1, key, buckets, spread, rows.schema.json())
    first = replace(first, folders=_write(rows, path, first))
    if not _claim(rows.sparkSession, path, first):
        raise FileExistsError(f"{path} is there already")
    return first


def latest(spark: SparkSession, path: str) -> Version:
    return _load(spark, path, max(_numbers(spark, path)))


def read(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """The table as it is, or as it was in an older version that is still held."""
    version = latest(spark, path) if number is None else _load(spark, path, number)
    return _rows(spark, path, version, version.folders)


def change(
    changes: DataFrame, path: str, merge: Callable[[DataFrame, DataFrame], DataFrame], applied: tuple[str, int] | None = None, tries: int = TRIES
) -> Version:
    """Make ``merge(rows, changes)`` the next version, where ``rows`` are those of the buckets that ``changes`` touch.

    ``changes`` have the table's key column; ``merge`` gives the table's columns and keys of these two alone. With
    ``applied`` (a stream's name, its batch), a batch that an earlier version holds changes nothing.
    """
    spark, done = changes.sparkSession, None
    with staging(spark):
        held = stage(changes, "changes")
        touched = None
        for attempt in range(1, tries + 1):
            now = latest(spark, path)
            if applied and now.applied.get(applied[0], -1) >= applied[1]:
                return now
            if touched is None:  # at most a row a bucket; buckets and key never change
                touched = {r[0] for r in held.select(now.bucket()).distinct().collect()}
            before = {b: f for b, f in now.folders.items() if b in touched}
            if done is None or before != done[0]:
                done = before, _write(merge(_rows(spark, path, now, before), held), path, now) if touched else {}
                if strange := set(done[1]) - touched:
                    raise ValueError(f"the merge gave keys that no change has, in buckets {sorted(strange)}")
            kept = {b: f for b, f in now.folders.items() if b not in touched}
            after = replace(now, number=now.number + 1, folders=kept | done[1], applied=now.applied | dict([applied] if applied else []))
            if _claim(spark, path, after):
                return after
            time.sleep(WAIT * attempt)
    raise TimeoutError(f"{path} was changed by others in each of {tries} tries")


def drop_before(spark: SparkSession, path: str, number: int) -> None:
    """Delete the versions before ``number`` and the files that no later one names; none may be written meanwhile."""
    fs, at = _files(spark, path)
    held = {n: _load(spark, path, n) for n in _numbers(spark, path) if n >= number}
    for n in set(_numbers(spark, path)) - set(held):
        fs.delete(at(f"versions/{n:012d}.json"), False)
    named = {(b, f) for v in held.values() for b, f in v.folders.items()}
    for folder in _names(fs, at("data")):
        buckets = {b.split("=", 1)[1] for b in _names(fs, at(f"data/{folder}")) if b.startswith("__bucket=")}
        gone = {b for b in buckets if (b, folder) not in named}
        for name in [f"data/{folder}"] if gone == buckets else [f"data/{folder}/__bucket={b}" for b in gone]:
            fs.delete(at(name), True)


def _rows(spark: SparkSession, path: str, version: Version, folders: dict[str, str]) -> DataFrame:
    schema = version.fields()
    paths = [f"{path}/data/{f}/__bucket={b}" for b, f in sorted(folders.items())]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _write(rows: DataFrame, path: str, version: Version) -> dict[str, str]:
    """Write ``rows`` by bucket to a folder of their own; the buckets that have any."""
    rows, folder = rows.select(*version.columns), uuid.uuid4().hex
    rows.withColumn("__bucket", version.bucket()).repartition("__bucket").write.partitionBy("__bucket").parquet(f"{path}/data/{folder}")
    fs, at = _files(rows.sparkSession, path)
    return {name.split("=", 1)[1]: folder for name in _names(fs, at(f"data/{folder}")) if name.startswith("__bucket=")}


def _files(spark: SparkSession, path: str) -> tuple:
    def at(name: str):
        return spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")

    return at("data").getFileSystem(spark._jsc.hadoopConfiguration()), at


def _names(fs, folder) -> Iterable[str]:
    return [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []


def _numbers(spark: SparkSession, path: str) -> list[int]:
    fs, at = _files(spark, path)
    found = [int(name.split(".")[0]) for name in _names(fs, at("versions")) if name.endswith(".json") and not name.startswith(".")]
    if not found:
        raise FileNotFoundError(f"no table at {path}")
    return found


def _load(spark: SparkSession, path: str, number: int) -> Version:
    fs, at = _files(spark, path)
    stream = fs.open(at(f"versions/{number:012d}.json"))
    try:
        return Version(**json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
    finally:
        stream.close()


def _claim(spark: SparkSession, path: str, version: Version) -> bool:
    """Put a version's file in its place, whole and once: false if another writer has that number."""
    fs, at = _files(spark, path)
    ready, final = at(f"versions/.{uuid.uuid4().hex}"), at(f"versions/{version.number:012d}.json")
    out = fs.create(ready, False)
    out.write(bytearray(json.dumps(asdict(version)).encode()))
    out.close()
    try:
        if fs.getUri().getScheme() != "file":
            return not fs.exists(final) and fs.rename(ready, final)
        os.link(ready.toUri().getPath(), final.toUri().getPath())  # a local rename would replace
        return True
    except FileExistsError:
        return False
    finally:
        fs.delete(ready, False)
