"""Streams of files: lines are matched, invoices imported and missing texts logged, each file and text once over restarts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..config import MatchConfig
from ..operators import feedback
from ..plans.cascade import Dimensions, match
from ..sources import invoices
from ..staging import staging

LINES = "invoice string, pos long, text string, invoice_price double, quantity double"
FILES = "path string, modificationTime timestamp, length long, content binary"


def match_stream(
    spark: SparkSession, source: str, target: str, checkpoint: str, dims: Dimensions, config: MatchConfig = MatchConfig(), schema: str = LINES
) -> StreamingQuery:
    """Match Parquet files as they come into ``source``; a batch that runs again replaces itself."""
    def sink(batch: DataFrame, epoch: int) -> None:
        with staging(batch.sparkSession):  # what a batch stages goes with it
            match(batch, dims, config).write.mode("overwrite").parquet(f"{target}/epoch={epoch}")

    return spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def import_stream(
    spark: SparkSession, folder: str, target: str, checkpoint: str, extract: Callable[[bytes], list], reader: Callable[..., invoices.Imported] = invoices.read_files
) -> StreamingQuery:
    """Import the .pdf files that come into ``folder``: rows, headers and failures of each micro-batch go to folders of
    ``target`` that a batch that runs again replaces. The checkpoint knows the files that were read."""
    def sink(batch: DataFrame, epoch: int) -> None:
        with staging(batch.sparkSession):
            got = reader(batch, extract)
            for name in ("rows", "headers", "failed"):
                getattr(got, name).write.mode("overwrite").parquet(f"{target}/{name}/epoch={epoch}")

    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", "*.[pP][dD][fF]").load(folder)
    return files.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def missing_stream(spark: SparkSession, source: str, log: str, checkpoint: str, schema: str, name: str = "missing", files: int | None = None) -> StreamingQuery:
    """Log the records of Parquet files that come into ``source``: a text once over all micro-batches and restarts.

    The state is the log itself, in versions: its buckets hold the texts that were seen, and each version holds the last
    batch of the stream ``name``, so a batch that runs again adds nothing, not even records without a text.
    """
    def sink(batch: DataFrame, epoch: int) -> None:
        feedback.log_missing(batch, log, applied=(name, epoch))

    records = spark.readStream.schema(schema)
    records = (records.option("maxFilesPerTrigger", files) if files else records).parquet(source)
    return records.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
