"""WARC records and a Merkle fixity audit of replicas.

A record is written as a WARC/1.0 resource record. Records of one file, in the order of
their ids, have consecutive byte ranges. Leaves of the file's tree hash a record's digest,
offset and length; an inner node hashes up to FAN_OUT children in order and covers their
offset range. The audit compares the roots of two replicas and descends only below nodes
that differ, so what it compares grows with the corruption and not with the archive.

Defined results: a null url or html is written as empty; rows without an id go to
NO_ID_FILES files "none-...", dealt by a hash. Line ends in a url are written as %0D and %0A.
Repeated rows are records of their own. A record is reported as corrupt (digest
differs), moved (same digest, other range), missing or extra. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow, stage

FAN_OUT = 16
RECORDS_PER_FILE = 1024
NO_ID_FILES = 4096
MARK = "WARC/1.0\r\n"
END = "\r\n\r\n"


def record_text(id: Column, url: Column, html: Column, date: str = "1970-01-01T00:00:00Z") -> Column:
    """A record without the two line ends that follow it."""
    body = F.coalesce(html, F.lit(""))
    url = F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.concat(
        F.lit(MARK + "WARC-Type: resource\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nWARC-Record-ID: <urn:record:"), F.coalesce(id.cast("string"), F.lit("")),
        F.lit(f">\r\nWARC-Date: {date}\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"),
        F.lit(END), body,
    )


def records(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(warc_file, record_id, record) of each page."""
    number = F.floor(F.col(id) / F.lit(RECORDS_PER_FILE))
    apart = F.pmod(F.xxhash64(url, html), F.lit(NO_ID_FILES))
    name = F.when(F.col(id).isNull(), F.format_string("none-%04d", apart)).otherwise(F.format_string("part-%08d", number))
    return pages.select(name.alias("warc_file"), F.col(id).alias("record_id"), record_text(F.col(id), F.col(url), F.col(html)).alias("record"))


def layout(records: DataFrame) -> DataFrame:
    """(warc_file, n, record_id, digest, offset, length): place and SHA-256 of each record."""
    slim = records.select(
        "warc_file", "record_id", F.sha2("record", 256).alias("digest"), (F.octet_length("record") + len(END)).cast("long").alias("length")
    )
    order = Window.partitionBy("warc_file").orderBy("record_id", "digest")
    return slim.select(
        "warc_file", (F.row_number().over(order) - 1).cast("long").alias("n"), "record_id", "digest",
        (F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("length")).alias("offset"), "length",
    )


def write(records: DataFrame, path: str) -> None:
    """One file for each warc_file, under ``path``/warc_file=..., records in the order of ``layout``."""
    rows = records.withColumn("digest", F.sha2("record", 256)).repartition("warc_file")
    rows = rows.sortWithinPartitions("warc_file", "record_id", "digest").select("warc_file", F.col("record").alias("value"))
    rows.write.partitionBy("warc_file").option("lineSep", END).text(path)


_FIELDS = {name: re.compile(rb"(?m)^" + name.encode() + rb": (.*?)\r?$") for name in ("WARC-Record-ID", "WARC-Target-URI", "Content-Length")}
_ID = re.compile(rb"<urn:record:(-?\d+)>")


def _split(data: bytes) -> Iterator[tuple[int, bytes, bytes, bool]]:
    """(offset, head, body, complete) of each record. A body is as long as its head states, whatever
    it quotes; where that does not lead to a record's end, it goes to the next record that begins after an end."""
    at, mark, end = 0, MARK.encode(), END.encode()
    while at < len(data):
        stop = data.find(end, at)
        head = data[at : stop if stop >= 0 else len(data)]
        begin = stop + len(end) if stop >= 0 else len(data)
        length = _FIELDS["Content-Length"].search(head)
        close = begin + int(length[1]) if length and length[1].isdigit() else -1
        complete = close >= begin and data[close : close + len(end)] == end and data[close + len(end) : close + len(end) + len(mark)] in (b"", mark)
        if not complete:
            following = data.find(end + mark, begin)
            close = following if following >= 0 else max(begin, len(data) - (len(end) if data.endswith(end) else 0))
        yield at, head, data[begin:close], complete
        at = close + len(end)


READ_SCHEMA = "warc_file string, record_id long, url string, html string, complete boolean, offset long, length long, digest string"


def read(spark, path: str) -> DataFrame:
    """(warc_file, record_id, url, html, complete, offset, length, digest) of files that ``write`` made.

    A file, of RECORDS_PER_FILE records, is read as a whole and split by Content-Length. ``complete``
    is false for a record whose content has not the length its header states. ``digest`` is of the
    bytes as they are stored, headers included, so ``stored_layout`` sees a rotten header too.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        fields = [f.split() for f in READ_SCHEMA.split(", ")]
        kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
        schema = pa.schema([(name, kinds[kind]) for name, kind in fields])
        for batch in batches:
            for name, data in zip(batch.column("path"), batch.column("content")):
                file = re.search(r"warc_file=([^/]*)", name.as_py())
                found = []
                for at, head, body, complete in _split(data.as_py()):
                    said = {k: (m[1] if (m := p.search(head)) else b"") for k, p in _FIELDS.items()}
                    id = _ID.search(said["WARC-Record-ID"])
                    raw = head + END.encode() + body
                    found.append((
                        file and file[1], id and int(id[1]), said["WARC-Target-URI"].decode("utf-8", "replace"), body.decode("utf-8", "replace"),
                        complete, at, len(raw) + len(END), hashlib.sha256(raw).hexdigest(),
                    ))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), schema)], schema=schema)

    return arrow(files).mapInArrow(run, READ_SCHEMA)


def stored_layout(read: DataFrame) -> DataFrame:
    """The layout of files as ``read`` found them, to audit against the one they were written by."""
    order = Window.partitionBy("warc_file").orderBy("offset")
    return read.select("warc_file", (F.row_number().over(order) - 1).cast("long").alias("n"), "record_id", "digest", "offset", "length")


def levels_of(*layouts: DataFrame) -> int:
    """Levels of inner nodes that bring the largest file to one root."""
    most = max(x.agg(F.max("n")).first()[0] or 0 for x in layouts)
    height = 1
    while FAN_OUT**height <= most:
        height += 1
    return height


def tree(layout: DataFrame, height: int) -> DataFrame:
    """(level, warc_file, n, begin, end, hash): the nodes of all files, leaves at level 0."""
    leaf = F.sha2(F.concat_ws(" ", "digest", "offset", "length"), 256)
    level = layout.select("warc_file", "n", F.col("offset").alias("begin"), (F.col("offset") + F.col("length")).alias("end"), leaf.alias("hash"))
    out = level.select(F.lit(0).alias("level"), "*")
    for k in range(1, height + 1):
        children = F.transform(F.array_sort(F.collect_list(F.struct("n", "hash"))), lambda c: c["hash"])  # FAN_OUT at most
        level = level.groupBy("warc_file", F.floor(F.col("n") / FAN_OUT).alias("parent")).agg(
            F.min("begin").alias("begin"), F.max("end").alias("end"), F.sha2(F.concat_ws("", children), 256).alias("hash")
        ).withColumnRenamed("parent", "n")
        out = out.union(level.select(F.lit(k).alias("level"), "*"))
    return out


def audit(original: DataFrame, replica: DataFrame) -> DataFrame:
    """(warc_file, record_id, offset, length, status, expected, found) of each record that
    differs; ``original`` and ``replica`` are layouts. Offsets are the original's, or the
    replica's for an extra record."""
    height = levels_of(original, replica)
    one, two = (stage(tree(x, height), "tree") for x in (original, replica))
    wrong = None
    for level in range(height, -1, -1):
        a, b = (x.where(F.col("level") == level).select("warc_file", "n", "hash") for x in (one, two))
        if wrong is not None:  # only children of nodes that differ
            above = wrong.withColumnRenamed("n", "parent")
            a, b = (x.withColumn("parent", F.floor(F.col("n") / FAN_OUT)).join(above, ["warc_file", "parent"], "left_semi").drop("parent") for x in (a, b))
        both = a.withColumnRenamed("hash", "x").join(b.withColumnRenamed("hash", "y"), ["warc_file", "n"], "full")
        wrong = stage(both.where(~F.col("x").eqNullSafe(F.col("y"))).select("warc_file", "n"), "differing")
    sides = []
    again = Window.partitionBy("warc_file", "record_id").orderBy("n")
    for x, p in ((original, "a"), (replica, "b")):
        rows = x.join(wrong, ["warc_file", "n"], "left_semi").withColumn("again", F.row_number().over(again))
        sides.append(rows.select("warc_file", "record_id", "again", *(F.col(c).alias(f"{p}_{c}") for c in ("digest", "offset", "length"))))
    left, right = sides[0].alias("l"), sides[1].alias("r")
    on = F.expr("l.warc_file = r.warc_file and l.record_id <=> r.record_id and l.again = r.again")
    status = (
        F.when(F.col("b_digest").isNull(), "missing").when(F.col("a_digest").isNull(), "extra")
        .when(F.col("a_digest") != F.col("b_digest"), "corrupt").otherwise("moved")
    )
    return left.join(right, on, "full").select(
        F.coalesce("l.warc_file", "r.warc_file").alias("warc_file"), F.coalesce("l.record_id", "r.record_id").alias("record_id"),
        F.coalesce("a_offset", "b_offset").alias("offset"), F.coalesce("a_length", "b_length").alias("length"),
        status.alias("status"), F.col("a_digest").alias("expected"), F.col("b_digest").alias("found"),
    )
