"""Dump lines as a stream: files that arrive later are parsed once, from where the checkpoint left off."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from linkloom.sources.dumps import parse_tuples


def tuple_stream(spark: SparkSession, folder: str, kind: str, files_per_batch: int = 16) -> DataFrame:
    return parse_tuples(spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder), kind)


def ingest(spark: SparkSession, folder: str, kind: str, out: str, checkpoint: str) -> StreamingQuery:
    """All files there are now, appended to out as Parquet; each file exactly once over any number of calls."""
    return tuple_stream(spark, folder, kind).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
