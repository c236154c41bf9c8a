"""Exact medians of groups of any size.

A buffer for each group, as the built-in aggregate has, grows with the group's distinct values. Here values go to buckets by a quantile sketch, counts for each bucket say in which bucket of
each group the middle ranks lie, and only the rows of those buckets are ranked, equal values as one. What is shuffled is a count for each group and bucket and a bucket's share of the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.names import named
from textloom.operators.ordering import bucketed


def medians(df: DataFrame, value: str, by: list[str], name: str = "median") -> DataFrame:
    """by, ``name``: the middle value as a double, the mean of both middle ones where their number is even, NaN above all numbers. Null values don't count; groups without any value are left
    out; null is a group. Without ``by`` one row, or none."""
    group = F.struct(*[named(c).alias(f"b{i}") for i, c in enumerate(by)], F.lit(0).alias("one"))
    own = df.select(group.alias("g"), named(value).cast("double").alias("v")).where("v IS NOT NULL")
    own = bucketed(own, ["v"], "part").withColumn("k", F.struct("g", "part"))
    before = Window.partitionBy("g").orderBy("k.part").rowsBetween(Window.unboundedPreceding, -1)
    counts = own.groupBy("k").agg(F.count("*").alias("n")).withColumn("g", F.col("k.g"))
    counts = counts.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("total", F.sum("n").over(Window.partitionBy("g")))
    lo, hi = F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)
    middle = counts.where((F.col("first") <= hi) & (F.col("first") + F.col("n") > lo)).select("k", "first", lo.alias("lo"), hi.alias("hi"))
    ranked = own.join(middle, "k").groupBy("k", "v").agg(F.count("*").alias("c"), F.first("first").alias("first"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    at = F.col("first") + F.coalesce(F.sum("c").over(Window.partitionBy("k").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = lambda r: (F.col("at") <= F.col(r)) & (F.col("at") + F.col("c") > F.col(r))
    picked = ranked.withColumn("at", at).groupBy("k.g").agg(F.max(F.when(inside("lo"), F.col("v"))).alias("low"), F.max(F.when(inside("hi"), F.col("v"))).alias("high"))
    return picked.select(*[F.col("g").getField(f"b{i}").alias(c) for i, c in enumerate(by)], F.when(F.col("low") == F.col("high"), F.col("low")).otherwise((F.col("low") + F.col("high")) / 2).alias(name))
