"""Splits, shard assignment and batches, all from explicit order columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.numbers import hash32
from textloom.operators.ordering import row_numbers


def by_shard(df: DataFrame, shard: str, validation: str = "first", fallback: bool = False) -> DataFrame:
    """Adds split: the first (or last) shard is val. With ``fallback`` a lone shard is both, as two rows each."""
    ends = df.agg(F.min(shard).alias("lo"), F.max(shard).alias("hi"))
    own = df.crossJoin(F.broadcast(ends))  # one row
    is_val = F.col(shard) == F.col("lo" if validation == "first" else "hi")
    split = F.when(is_val, F.lit("val")).otherwise(F.lit("train"))
    if not fallback:
        return own.withColumn("split", split).drop("lo", "hi")
    both = F.when(F.col("lo") == F.col("hi"), F.array(F.lit("train"), F.lit("val"))).otherwise(F.array(split))
    return own.withColumn("split", F.explode(both)).drop("lo", "hi")


def by_fraction(df: DataFrame, shard: str, order: str, fraction: float) -> DataFrame:
    """Adds split: the first max(1, int(fraction * n)) rows of each shard are val."""
    sizes = df.groupBy(shard).agg(F.greatest(F.lit(1), F.floor(F.lit(fraction) * F.count("*"))).alias("__val"))
    own = row_numbers(df, [order], "__k", [shard]).join(sizes, shard)
    return own.withColumn("split", F.when(F.col("__k") < F.col("__val"), F.lit("val")).otherwise(F.lit("train"))).drop("__k", "__val")


def shard_owners(shards: DataFrame, world: int, workers: int = 1, share: bool = True) -> DataFrame:
    """shard, rank, worker: worker w of rank r reads shard i if i and r * workers + w agree modulo the number of readers, or, with
    ``share``, modulo the number of shards if there are fewer."""
    total = world * workers
    counted = shards.crossJoin(F.broadcast(shards.agg(F.count("*").alias("n"))))
    modulus = F.least(F.lit(total), F.col("n")) if share else F.lit(total)
    readers = F.filter(F.sequence(F.lit(0), F.lit(total - 1)), lambda x: F.pmod(x, modulus.cast("int")) == F.pmod(F.col("shard"), modulus).cast("int"))
    return counted.select("shard", F.explode(readers).alias("reader")).select("shard", F.floor(F.col("reader") / workers).cast("long").alias("rank"), F.pmod("reader", F.lit(workers)).cast("long").alias("worker"))


def of_rank(df: DataFrame, index: str, world: int, rank: int) -> DataFrame:
    return df.where(F.pmod(F.col(index), F.lit(world)) == rank)


def batches(df: DataFrame, order: str, size: int, *values: str) -> DataFrame:
    """batch and an array of each value column in order; the last batch may be short."""
    own = row_numbers(df, [order], "n").withColumn("batch", F.floor(F.col("n") / size).cast("long"))
    rows = F.sort_array(F.collect_list(F.struct("n", *values)))
    return own.groupBy("batch").agg(rows.alias("rows")).select("batch", *[F.col(f"rows.{v}").alias(v) for v in values])


def cycled(df: DataFrame, order: str, quota: int) -> DataFrame:
    """Adds turn: the rows in order, repeated until there are ``quota``."""
    own = row_numbers(df, [order], "n")
    counted = own.crossJoin(F.broadcast(own.agg(F.count("*").alias("total"))))
    times = F.when(F.col("n") < quota, F.floor((F.lit(quota - 1) - F.col("n")) / F.col("total")) + 1).otherwise(0)
    again = F.when(times > 0, F.sequence(F.lit(0).cast("long"), times - 1)).otherwise(F.array().cast("array<bigint>"))
    return counted.withColumn("again", F.explode(again)).withColumn("turn", F.col("n") + F.col("again") * F.col("total")).drop("n", "total", "again")


def by_file(df: DataFrame, file: str, splits: dict[str, list[str]]) -> DataFrame:
    """Adds split: the one whose files the row's file is among, for tables that come with splits of their own; rows of other files go."""
    name = F.lit(None).cast("string")
    for split, files in splits.items():
        name = F.when(F.col(file).isin(files), F.lit(split)).otherwise(name)
    return df.where(F.col(file).isin([f for files in splits.values() for f in files])).withColumn("split", name)


def shuffled(df: DataFrame, key: str, seed: int, name: str = "place") -> DataFrame:
    """Adds ``name``: the row's place (from 0) in an order drawn from the seed and the whole number ``key``."""
    hidden = f"__{name}"
    own = df.withColumn(hidden, hash32((F.col(key).cast("long") + F.lit(seed)).bitwiseAND(F.lit(0xFFFFFFFF))))
    return row_numbers(own, [hidden, key], name).drop(hidden)
