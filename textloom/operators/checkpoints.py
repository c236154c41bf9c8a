"""Helpers around training runs: the newest of numbered files, and the arithmetic of model size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def step_of(path: Column) -> Column:
    """The number before the extension; -1 if there is none."""
    return F.coalesce(F.nullif(F.regexp_extract(path, r"(\d+)(?:\.[A-Za-z]+)?$", 1), F.lit("")).try_cast("long"), F.lit(-1).cast("long"))


def latest(df: DataFrame, path: str, by: str | None = None) -> DataFrame:
    """The path with the largest number (of each group)."""
    best = F.max(F.struct(step_of(F.col(path)).alias("step"), F.col(path).alias("path"))).alias("b")
    grouped = df.groupBy(by) if by else df.groupBy()
    return grouped.agg(best).select(*([by] if by else []), "b.path", "b.step")


def flops_per_token(parameters: int, embedding: int, layers: int, heads: int, head_size: int, context: int) -> int:
    """Six for each weight outside the embedding, and twelve for each position an attention head looks at."""
    return 6 * (parameters - embedding) + 12 * layers * heads * head_size * context
