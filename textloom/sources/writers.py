"""Sinks: numbered Parquet shards, single files, idempotent writes and metric tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators.ordering import row_numbers

SHARD_ROWS = 50_000


def shard_name(index: Column) -> Column:
    return F.format_string("shard_%05d.parquet", index)


def shard_assignment(df: DataFrame, *order: str, rows: int = SHARD_ROWS) -> DataFrame:
    """Adds shard: rows in order, ``rows`` to each."""
    return row_numbers(df, list(order), "n").withColumn("shard", F.floor(F.col("n") / rows).cast("long")).drop("n")


def write_shards(df: DataFrame, path: str, *order: str, rows: int = SHARD_ROWS, mode: str = "error") -> None:
    """Contiguous ranges of rows, at most ``rows`` to a file. Ranges follow the order; a range's last file may be short."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.option("maxRecordsPerFile", rows).mode(mode).parquet(path)


def write_once(df: DataFrame, path: str) -> None:
    """Does nothing if there is something already."""
    df.write.mode("ignore").parquet(path)


def append_metrics(df: DataFrame, path: str, step: int) -> None:
    """Rows of (metric, value) for one step, added to a table."""
    df.select(F.lit(step).cast("long").alias("step"), "metric", F.col("value").cast("double").alias("value")).write.mode("append").parquet(path)


def report_lines(df: DataFrame, **formats: str) -> DataFrame:
    """Rows as lines of text (line), each column by its printf format."""
    return df.select(F.format_string(" | ".join(formats.values()), *formats).alias("line"))


def write_single(df: DataFrame, path: str) -> None:
    """One Parquet file, for tables of a size that one task can write."""
    df.coalesce(1).write.parquet(path)
