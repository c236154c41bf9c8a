"""Statistics of corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.messages import n_turns, of_role, total_chars
from textloom.functions.text import jaccard, simple_words
from textloom.operators.quantiles import medians

SWITCH = 0.05


def turn_distribution(conversations: DataFrame) -> DataFrame:
    """One row on the number of assistant turns. The median is exact."""
    t = conversations.select(n_turns(F.col("messages")).alias("t"))
    share = lambda cond: F.count_if(cond) / F.count("*")
    c = F.col("t")
    return t.agg(
        F.count("*").alias("n"), F.avg("t").alias("mean"), F.median("t").alias("median"), F.max("t").alias("max"),
        share(c == 1).alias("share_1"), share(c == 2).alias("share_2"), share((c >= 3) & (c <= 4)).alias("share_3_4"), share(c >= 5).alias("share_5_up"), share(c >= 3).alias("share_3_up"),
    )


def turn_bucket(t: Column) -> Column:
    return F.when(t <= 1, "1").when(t == 2, "2").when(t <= 4, "3-4").when(t <= 9, "5-9").otherwise("10+")


def turn_histogram(conversations: DataFrame) -> DataFrame:
    """bucket, n, bar (length of a bar of 20 for all)."""
    own = conversations.select(turn_bucket(n_turns(F.col("messages"))).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))
    total = own.agg(F.sum("n").alias("total"))
    return own.crossJoin(F.broadcast(total)).select("bucket", "n", F.greatest(F.lit(1), F.bround(F.col("n") / F.col("total") * 20)).cast("long").alias("bar"))


def topic_jaccard(m: Column) -> Column:
    """Similarity of the first user turn's words with those of each later one."""
    own = F.transform(of_role(m, "user"), lambda x: simple_words(x.content))
    later = F.slice(own, F.lit(2), F.greatest(F.size(own) - 1, F.lit(0)))
    return F.transform(later, lambda w: jaccard(F.get(own, 0), w))


def topic_switches(conversations: DataFrame) -> DataFrame:
    """One row for each source, over conversations with two user turns or more: n, mean similarity, share with a switch, mean user turns."""
    own = conversations.select("source", topic_jaccard(F.col("messages")).alias("s"), F.size(of_role(F.col("messages"), "user")).alias("users")).where("users >= 2")
    total = F.aggregate("s", F.lit(0.0), lambda a, x: a + x)
    return own.groupBy("source").agg(
        F.count("*").alias("n"), (F.sum(total) / F.sum(F.size("s"))).alias("mean_jaccard"),
        F.avg(F.exists("s", lambda x: x < SWITCH).cast("double")).alias("switch_share"), F.avg("users").alias("mean_user_turns"),
    )


def preference_stats(pairs: DataFrame) -> DataFrame:
    """One row for each measure (chars, turns): means and medians of both sides, and mean, median, min and max of the difference."""
    sides = {"chars": total_chars, "turns": n_turns}
    rows = F.array(*[F.struct(F.lit(k).alias("measure"), f(F.col("chosen")).alias("c"), f(F.col("rejected")).alias("r")) for k, f in sides.items()])
    own = pairs.select(F.inline(rows)).withColumn("d", F.col("c") - F.col("r"))
    sums = own.groupBy("measure").agg(
        F.count("*").alias("n"), F.avg("c").alias("chosen_mean"), F.avg("r").alias("rejected_mean"),
        F.avg("d").alias("diff_mean"), F.min("d").alias("diff_min"), F.max("d").alias("diff_max"),
    )
    names = F.array(*[F.struct(F.lit(n).alias("name"), F.col(c).cast("double").alias("v")) for n, c in (("chosen_median", "c"), ("rejected_median", "r"), ("diff_median", "d"))])
    middle = medians(own.select("measure", F.inline(names)), "v", ["measure", "name"])
    wide = middle.groupBy("measure").agg(*[F.max(F.when(F.col("name") == n, F.col("median"))).alias(n) for n in ("chosen_median", "rejected_median", "diff_median")])
    return sums.join(wide, "measure", "left")


def world_knowledge(df: DataFrame, f1: Column, same: Column) -> DataFrame:
    return df.agg(F.count("*").alias("n"), F.avg(same.cast("double")).alias("accuracy"), F.avg(f1).alias("token_f1"))


def classification(df: DataFrame, predicted: str, actual: str, positive: int = 1) -> DataFrame:
    """One row: accuracy and F1 of the positive class."""
    p, a = F.col(predicted) == positive, F.col(actual) == positive
    hits, n_p, n_a = F.count_if(p & a), F.count_if(p), F.count_if(a)
    return df.agg(F.avg((F.col(predicted) == F.col(actual)).cast("double")).alias("accuracy"), F.when(n_p + n_a > 0, 2 * hits / (n_p + n_a)).otherwise(0.0).alias("f1"))


def training_steps(chunks: Column, batch: int = 18, ranks: int = 4, accumulate: int = 1) -> Column:
    return F.floor(chunks / (batch * ranks * accumulate))
