"""Rewards and returns. Running generated code is left to the caller: it needs a sandbox that Spark doesn't have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.text import extract_code, last_number, parse_number, strip, within_tolerance

GAMMA = 0.99


def score_stdout(stdout: Column, expected: Column, success: Column) -> Column:
    """0.3 for success; for a number 0.2 more, and 0.5 if it is the expected one; for other output 0.7 if it is the same text."""
    got, want = parse_number(stdout), parse_number(expected)
    numeric = got.isNotNull() & want.isNotNull()
    base = F.when(success, 0.3).otherwise(0.0)
    same = F.lower(strip(stdout)) == F.lower(strip(expected))
    return F.round(base + F.when(numeric, 0.2 + F.when(within_tolerance(got, want), 0.5).otherwise(0.0)).when(success & same, 0.7).otherwise(0.0), 6)


def score_text(text: Column, expected: Column) -> Column:
    """Reward of an answer without code: 1 if its last number is the expected one, 0.1 if it has another, 0 if none."""
    got, want = last_number(text).try_cast("double"), parse_number(expected)
    return F.when(extract_code(text).isNotNull(), F.lit(None).cast("double")).when(got.isNull(), 0.0).when(F.coalesce(within_tolerance(got, want), F.lit(False)), 1.0).otherwise(0.1)


def score_tests(has_code: Column, valid: Column, passed: Column) -> Column:
    """Reward of a program with tests: nothing without valid code, else 0.3, and 0.7 for the share of passed tests."""
    return F.when(has_code & valid, 0.3 + 0.7 * passed).otherwise(0.0)


def generation_mask(prompt: Column, generated: Column, max_new: int) -> Column:
    """Mask over prompt + max_new - 1 positions with ones where generated tokens are predicted."""
    ones = lambda n, v: F.array_repeat(F.lit(v), n)
    return F.concat(ones(prompt - 1, 0), ones(generated, 1), ones(F.lit(max_new) - generated, 0))


def discounted_returns(advantage: Column, n: Column, gamma: float = GAMMA) -> Column:
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda t: advantage * F.pow(F.lit(gamma), n - 1 - t))


def advantages(df: DataFrame, reward: str, batch: str) -> DataFrame:
    """Adds advantage: the reward less its mean over the batch."""
    return df.withColumn("advantage", F.col(reward) - F.avg(reward).over(Window.partitionBy(batch)))


def policy_loss(df: DataFrame) -> DataFrame:
    """One row: sum of ce * mask * ret over the number of masked tokens."""
    return df.agg((F.sum(F.col("ce") * F.col("mask") * F.col("ret")) / F.greatest(F.lit(1), F.sum("mask"))).alias("loss"))


def by_problem_type(df: DataFrame) -> DataFrame:
    """Mean reward and the share of positive ones, for each problem_type."""
    return df.groupBy("problem_type").agg(F.count("*").alias("n"), F.avg("reward").alias("mean_reward"), F.avg((F.col("reward") > 0).cast("double")).alias("positive_rate"))
