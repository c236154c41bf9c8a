"""Global order without a one-task window.

Rows go to buckets by ranges of the first order column, from a quantile sketch, or of all order columns, from a sample of bounded size, where the first is no number or a few of its
values hold many rows. Sums for each bucket, at most ``BUCKETS`` rows (for each group), give the bucket's offset, and a window within the bucket does the rest,
so no task holds more than a bucket. Where the borders lie has no bearing on the result. Rows with nulls in ``by`` are a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.names import fresh, named

BUCKETS = 1024
SAMPLE = 32


def running_sum(df: DataFrame, order: list[str], value: Column, name: str, by: list[str] | None = None) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the rows before this one (in its ``by`` group if there is one)."""
    by = by or []
    part, amount, key, offset, total = (fresh(x, [*df.columns, name]) for x in ("part", "amount", "key", "offset", "total"))
    # a group's columns are one struct, so that null groups meet in the join and the window's shuffle serves it
    own = F.struct(*[named(c).alias(f"b{i}") for i, c in enumerate(by)], F.col(part).alias("part")) if by else F.col(part)
    rows = bucketed(df, order, part).withColumn(amount, value.cast("long")).withColumn(key, own).drop(part)
    totals = rows.groupBy(key).agg(F.sum(amount).alias(total))
    groups = Window.partitionBy(*[F.col(key).getField(f"b{i}") for i in range(len(by))]).orderBy(F.col(key).getField("part") if by else key)
    offsets = totals.select(key, F.coalesce(F.sum(total).over(groups.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(offset))
    within = Window.partitionBy(key).orderBy(*map(named, order)).rowsBetween(Window.unboundedPreceding, -1)
    summed = rows.withColumn(name, F.coalesce(F.sum(amount).over(within), F.lit(0)))
    return summed.join(offsets, key).withColumn(name, named(name) + F.col(offset)).drop(key, amount, offset)


def bucketed(df: DataFrame, order: list[str], name: str, buckets: int = BUCKETS) -> DataFrame:
    """Adds ``name``, which rises with the order columns (nulls first, as windows have them)."""
    n = min(buckets, max(2, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    if dict(df.dtypes)[order[0]] in ("bigint", "int", "smallint", "tinyint", "double", "float"):
        cuts = list(dict.fromkeys(df.approxQuantile(order[0], [i / n for i in range(1, n)], 0.25 / n)))
        if len(cuts) > n // 2 or len(order) == 1:
            return df.withColumn(name, F.when(F.col(order[0]).isNull(), -1).otherwise(part_of(F.col(order[0]), [F.lit(c) for c in cuts])))
    keys = df.select(*order)
    rows = keys.count()
    some = keys.sample(min(1.0, SAMPLE * n / max(rows, 1)), 1).orderBy(*order).limit(4 * SAMPLE * n).collect()
    picked = list(dict.fromkeys(tuple(some[i * len(some) // n]) for i in range(1, n))) if some else []
    cuts = [F.struct(*[F.lit(v).cast(df.schema[c].dataType).alias(c) for c, v in zip(order, own, strict=True)]) for own in picked]
    return df.withColumn(name, part_of(F.struct(*order), cuts))


def part_of(key: Column, cuts: list[Column]) -> Column:
    """Number of cuts at or below the key, by a tree of comparisons."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key < cuts[mid], tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return tree(0, len(cuts))


def row_numbers(df: DataFrame, order: list[str], name: str, by: list[str] | None = None) -> DataFrame:
    """Adds ``name``: rows before this one."""
    return running_sum(df, order, F.lit(1), name, by)
