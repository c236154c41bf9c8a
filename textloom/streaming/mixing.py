"""Streaming mixer: a rate source numbers the draws, and each micro-batch joins them to the source rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.numbers import LCG_M, lcg
from textloom.operators.mixing import pick_source


def draw_stream(spark: SparkSession, weights: dict[str, float], seed: int, rows_per_second: int = 100) -> DataFrame:
    """draw, source, without an end."""
    rate = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", rows_per_second).load()
    return rate.select(F.col("value").alias("draw")).withColumn("source", pick_source(lcg(F.col("draw"), seed) / LCG_M, weights))


def into(sink: Callable[[DataFrame, int], None], rows: DataFrame) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: draws joined to numbered rows (source, row, n, ...). The row is the draw's number modulo the source's size,
    so the choice needs no state and a repeated batch gives the same."""

    def step(batch: DataFrame, batch_id: int) -> None:
        sizes = rows.groupBy("source").agg(F.count("*").alias("__n"))
        at = batch.join(sizes, "source").withColumn("row", F.pmod("draw", F.col("__n"))).drop("__n")
        sink(at.join(rows, ["source", "row"]), batch_id)

    return step
