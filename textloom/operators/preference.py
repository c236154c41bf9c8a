"""Preference pairs: preparation, and the arithmetic of direct preference optimisation over tables of log-probabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.messages import parse_dialogue
from textloom.functions.numbers import log_sigmoid
from textloom.operators.ordering import row_numbers
from textloom.operators.tokens import PAD, pad_to, conversation_tokens

BETA = 0.1


def from_dialogues(df: DataFrame, source: str, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """Pairs parsed from dialogue texts; a pair with an empty side goes."""
    own = df.withColumn("chosen", parse_dialogue(F.col(chosen))).withColumn("rejected", parse_dialogue(F.col(rejected)))
    return own.where((F.size("chosen") > 0) & (F.size("rejected") > 0)).withColumn("source", F.lit(source))


def shared_prefix(a: Column, b: Column) -> Column:
    """struct<prefix, chosen_rest, rejected_rest>: the messages that both sides begin with, and the rest of each."""
    n = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: (x.role == y.role) & (x.content == y.content))
    first = F.array_position(same, F.lit(False)).cast("int")
    k = F.when(first == 0, n).otherwise(first - 1)
    rest = lambda m: F.slice(m, k + 1, F.size(m))
    return F.struct(F.slice(a, F.lit(1), k).alias("prefix"), rest(a).alias("chosen_rest"), rest(b).alias("rejected_rest"))


def prepared(df: DataFrame, size: int) -> DataFrame:
    """Ids and masks of both sides cut or padded to ``size``; a pair whose mask is empty on a side goes."""
    out = df
    for side in ("chosen", "rejected"):
        out = out.withColumn("__p", conversation_tokens(F.col(side)))
        out = out.withColumn(f"{side}_ids", pad_to(F.col("__p.t"), size, PAD)).withColumn(f"{side}_mask", pad_to(F.col("__p.m"), size, 0))
    trained = lambda c: F.array_contains(c, 1)
    return out.where(trained("chosen_mask") & trained("rejected_mask")).drop("__p")


def sequence_logprob(tokens: DataFrame, *keys: str) -> DataFrame:
    """Sum of log-probabilities under the mask, over positions from 1 on."""
    return tokens.where("pos >= 1").groupBy(*keys).agg(F.sum(F.col("logp") * F.col("mask")).alias("logprob"))


def dpo_loss(df: DataFrame, beta: float = BETA) -> DataFrame:
    """One row: loss, accuracy, margin, from policy_chosen, policy_rejected, ref_chosen, ref_rejected."""
    c = beta * (F.col("policy_chosen") - F.col("ref_chosen"))
    r = beta * (F.col("policy_rejected") - F.col("ref_rejected"))
    return df.agg(F.avg(-log_sigmoid(c - r)).alias("loss"), F.avg((c > r).cast("double")).alias("accuracy"), F.avg(c - r).alias("margin"))


def quota_split(df: DataFrame, order: str, total: int, source: str = "source") -> DataFrame:
    """Adds split: of each source the first total // sources rows are val, so each has the same share of the validation rows."""
    sources = df.select(source).distinct().agg(F.count("*").alias("__sources"))  # one row
    own = row_numbers(df, [order], "__k", [source]).crossJoin(F.broadcast(sources))
    return own.withColumn("split", F.when(F.col("__k") < F.floor(F.lit(total) / F.col("__sources")), F.lit("val")).otherwise(F.lit("train"))).drop("__k", "__sources")


def tagged_pairs(df: DataFrame, source: str, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """Both sides of each pair, with the name of the source; a pair that lacks a side goes."""
    return df.where(F.col(chosen).isNotNull() & F.col(rejected).isNotNull()).withColumn("source", F.lit(source))
