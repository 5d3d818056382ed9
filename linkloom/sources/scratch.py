"""Intermediate tables of iterative operators, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def folder(df: DataFrame) -> str:
    """The folder in spark.checkpoint.dir; one of our own only where a local session names none (tests)."""
    spark = df.sparkSession
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="linkloom-")
    sc.setCheckpointDir(own)
    return own


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written and read again: a plan of one scan whose size is that of its files.

    A checkpointed frame would keep the estimated size of the plan it came from, and estimates of joins
    of such frames multiply from round to round until planning fails.
    """
    path = f"{folder(df)}/rounds/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, parts: int | None, *keys: str) -> DataFrame:
    """The same rows, dealt out by keys into a number of parts that follows the input, so that what one task holds does not grow with it; None leaves it to Spark.

    Spark's own number of shuffle partitions is fixed, and adaptive execution merges small ones only.
    """
    return marked(df.repartition(parts, *keys), parts) if parts else df


def marked(df: DataFrame, parts: int | None) -> DataFrame:
    """df, noting into how many parts rows of its size are to be dealt."""
    df._parts = parts
    return df


def parts_of(df: DataFrame) -> int | None:
    return df.__dict__.get("_parts")
