"""Weighted mixing, sampling and quotas as joins and windows on draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions.names import fresh, named
from textloom.functions.numbers import LCG_M, MASK, hash32, lcg
from textloom.operators.ordering import row_numbers


def pick_source(u: Column, weights: dict[str, float]) -> Column:
    """The source whose share of the cumulative weights holds u (from 0 to 1)."""
    total, names = sum(weights.values()), list(weights)
    out, acc = F.lit(names[-1]), 1.0
    for name in reversed(names[:-1]):
        acc = sum(weights[x] for x in names[: names.index(name) + 1]) / total
        out = F.when(u < acc, F.lit(name)).otherwise(out)
    return out


def draws(spark: SparkSession, n: int, weights: dict[str, float], seed: int) -> DataFrame:
    """draw, source, k: the k-th draw of that source (from 0)."""
    rows = spark.range(n).withColumnRenamed("id", "draw").withColumn("source", pick_source(lcg(F.col("draw"), seed) / LCG_M, weights))
    return row_numbers(rows, ["draw"], "k", ["source"])


def mixed(draw_table: DataFrame, rows: DataFrame, order: str, stride: int = 1, offset: int = 0) -> DataFrame:
    """Each draw with its row: source, draw, and the columns of ``rows``. The k-th draw of a source takes row (offset + k * stride)
    modulo the source's rows, so a source begins again when it is used up. Sources without rows give none."""
    own = row_numbers(rows, [order], "__row", ["source"])
    sizes = own.groupBy("source").agg(F.count("*").alias("__n"))
    at = draw_table.join(sizes, "source").withColumn("__row", F.pmod(F.lit(offset) + F.col("k") * stride, F.col("__n"))).drop("__n")
    return at.join(own, ["source", "__row"]).drop("__row")


def sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows in the order of a hash; the planner keeps n rows of each task."""
    return df.orderBy(lcg(F.col(key), seed), F.col(key)).limit(n)


def sample_by(df: DataFrame, by: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows of each group (null is one), all of a smaller one: those with the lowest hash of the whole number ``key``, then the lowest key.

    Rows are counted by group and cell of the hash (its length in bits and the four bits after the first, at most 500 cells), summed before they are shuffled. The cells that begin below a
    group's n-th row hold n rows and few more, whatever the group's size, and only their rows are ranked. Counts are exact, so no group comes short. Rows meet the cells by group and cell, so a
    group is dealt to many tasks. Rows that share a key share its hash; null keys hash as 0 and come first."""
    hidden, cell, group, place = (fresh(x, df.columns) for x in ("hash", "cell", "group", "place"))
    own = df.withColumn(hidden, hash32((F.coalesce(named(key).cast("long"), F.lit(0)) + F.lit(seed)).bitwiseAND(F.lit(MASK))))
    low = F.greatest(F.length(F.bin(hidden)) - 5, F.lit(0))
    own = own.withColumn(cell, low * 16 + F.call_function("shiftright", F.col(hidden), low)).withColumn(group, F.struct(named(by).alias("b")))
    upward = Window.partitionBy(group).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    counts = own.groupBy(group, cell).agg(F.count("*").alias("c")).withColumn("below", F.coalesce(F.sum("c").over(upward), F.lit(0)))
    few = own.join(counts.where(F.col("below") < n).select(group, cell), [group, cell], "left_semi")
    ranked = few.withColumn(place, F.row_number().over(Window.partitionBy(group).orderBy(hidden, named(key))))
    return ranked.where(F.col(place) <= n).select(*[named(c) for c in df.columns])


def few_shot(items: DataFrame, idx: str, group: str, k: int, seed: int = 1234) -> DataFrame:
    """For each item k others of its group: idx, shot (from 0), other.

    The candidates of an item are the rows after a hashed starting point in the group's hashed order, so a lookup by rank finds
    them and no pairs are made."""
    own = row_numbers(items.select(group, idx).withColumn("__h", lcg(F.col(idx), seed)), ["__h", idx], "__r", [group])
    sizes = own.groupBy(group).agg(F.count("*").alias("__n"))
    asked = own.join(sizes, group).withColumn("shot", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).where(F.col("shot") < F.col("__n") - 1)
    asked = asked.withColumn("__at", F.pmod(F.col("__r") + 1 + F.col("shot"), F.col("__n")))
    others = own.select(group, F.col(idx).alias("other"), F.col("__r").alias("__at"))
    return asked.join(others, [group, "__at"]).select(group, idx, F.col("shot").cast("long").alias("shot"), "other")


def round_robin(items: DataFrame, kind: str, label: str, order: str, total: int) -> DataFrame:
    """Items by turns from the labels of each kind, with a quota for each kind: total over the number of kinds, the first get the rest.
    Adds place (from 0 in its kind)."""
    kinds = items.select(kind).distinct()
    ranked = kinds.withColumn("__k", F.row_number().over(Window.orderBy(kind)) - 1).crossJoin(F.broadcast(kinds.agg(F.count("*").alias("__n"))))
    quota = F.floor(F.lit(total) / F.col("__n")) + F.when(F.col("__k") < total % F.col("__n"), 1).otherwise(0)
    own = row_numbers(items, [order], "__cursor", [kind, label]).where(F.col("__cursor") < total)
    own = own.withColumn("place", (F.row_number().over(Window.partitionBy(kind).orderBy("__cursor", label)) - 1).cast("long"))
    return own.join(ranked.withColumn("__quota", quota), kind).where("place < __quota").drop("__cursor", "__k", "__n", "__quota")


def batch_draws(spark: SparkSession, batches: int, size: int, weights: dict[str, float], seed: int) -> DataFrame:
    """draw, batch, source, k: each batch draws one source and takes its next ``size`` rows."""
    own = draws(spark, batches, weights, seed).withColumnRenamed("draw", "batch")
    each = own.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(size - 1).cast("long"))))
    return each.select((F.col("batch") * size + F.col("i")).alias("draw"), "batch", "source", (F.col("k") * size + F.col("i")).alias("k"))
