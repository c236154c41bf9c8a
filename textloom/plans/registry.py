"""Registered queries and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textloom.functions.messages import nest
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Conversations as the SQL side sees them.
CHATS = "c AS (SELECT conv_id, list({'role': role, 'content': text} ORDER BY turn) AS m, ['smoltalk', 'lima', 'ultrachat_gen'][1 + conv_id % 3] AS source FROM conversations GROUP BY conv_id)"


def query(sql: str | None = None):
    """Registers a function under its name."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, messages, source."""
    names = F.array(F.lit("smoltalk"), F.lit("lima"), F.lit("ultrachat_gen"))
    return nest(table(spark, sf_dir, "conversations")).withColumn("source", F.get(names, F.pmod("conv_id", F.lit(3)).cast("int")))
