"""Connected components of a graph in a table, by alternating large and small stars.

Each round hangs the larger neighbours of every node below its least neighbour, then the smaller ones; after a few rounds
each node hangs below the least node of its component. A round is two aggregations with partial sums and two joins against a table
with one row for each node, whose skew Spark can split; it is written to the shared folder, so nothing is recomputed and nothing
comes to the driver but a count and a checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import discard, stored


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, component (the least node that links reach) for each node that isn't the least of its own. Nulls and loops count for nothing."""
    e = edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    e = stored(e.distinct(), "edges")
    before = mark(e)
    while True:
        both = e.select(F.col("hi").alias("x"), F.col("lo").alias("n")).unionAll(e.select(F.col("lo").alias("x"), F.col("hi").alias("n")))
        least = both.groupBy("x").agg(F.min("n").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.where("n > x").join(least, "x").select(F.col("n").alias("hi"), F.col("m").alias("lo")).where("hi > lo").distinct()
        large = stored(large, "edges")
        tops = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(tops, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi > lo").unionAll(tops.select("hi", F.col("m").alias("lo"))).distinct()
        small = stored(small, "edges")
        discard(large)
        discard(e)
        now = mark(small)
        if now == before:
            return small.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
        e, before = small, now


def mark(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(20,0)"))).first())
