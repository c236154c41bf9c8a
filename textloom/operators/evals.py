"""Evaluation: prompts from few-shot examples, spans to score, decisions from per-token losses, and task roll-ups.

A model's forward pass is outside; its results come as a table (example_id, option, pos, loss, pred, actual)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.messages import common_length
from textloom.functions.text import strip


def shots(fewshot: Column, first: str | Column, last: str, delimiter: str, trim: bool = False) -> Column:
    """Each example with a blank line after it."""
    left = (lambda x: first(x)) if callable(first) else (lambda x: strip(x[first]) if trim else x[first])
    right = (lambda x: last(x)) if callable(last) else (lambda x: x[last])
    return F.array_join(F.transform(fewshot, lambda x: F.concat(left(x), F.lit(delimiter), right(x), F.lit("\n\n"))), "")


def render_choices(fewshot: Column, query: Column, choices: Column, delimiter: str = " ") -> Column:
    """A prompt for each choice; examples have query, choices and gold."""
    head = shots(fewshot, "query", lambda x: F.get(x.choices, x.gold), delimiter)
    return F.transform(choices, lambda c: F.concat(head, query, F.lit(delimiter), c))


def render_schema(fewshot: Column, options: Column, continuation: Column, delimiter: str = " ") -> Column:
    """A prompt for each context; examples have context_options, gold and continuation."""
    head = shots(fewshot, lambda x: F.get(x.context_options, x.gold), "continuation", delimiter)
    return F.transform(options, lambda c: F.concat(head, c, F.lit(delimiter), continuation))


def render_completion(fewshot: Column, context: Column, continuation: Column, delimiter: str = " ") -> Column:
    """Two prompts: without the continuation (stripped) and with it; examples have context and continuation."""
    base = F.concat(shots(fewshot, "context", "continuation", delimiter, trim=True), strip(context), F.lit(delimiter))
    return F.array(strip(base), F.concat(base, continuation))


def spans_choices(tokens: Column) -> Column:
    """struct<start, end> for each option: what follows the common beginning."""
    start = common_length(tokens)
    return F.transform(tokens, lambda t: F.struct(start.alias("start"), F.size(t).cast("long").alias("end")))


def spans_schema(tokens: Column) -> Column:
    """The common end."""
    n = common_length(tokens, from_right=True)
    return F.transform(tokens, lambda t: F.struct((F.size(t) - n).alias("start"), F.size(t).cast("long").alias("end")))


def span_completion(tokens: Column) -> Column:
    """What the second sequence has after the first; null if it doesn't begin with it."""
    base, full = F.get(tokens, 0), F.get(tokens, 1)
    ok = F.slice(full, F.lit(1), F.size(base)) == base
    return F.when(ok, F.struct(F.size(base).cast("long").alias("start"), F.size(full).cast("long").alias("end")))


def decide(losses: DataFrame, spans: DataFrame, gold: DataFrame) -> DataFrame:
    """example_id, predicted, correct: the option with the least mean loss over [start - 1, end - 1), the first of ties."""
    scored = losses.join(spans, ["example_id", "option"]).where((F.col("pos") >= F.col("start") - 1) & (F.col("pos") < F.col("end") - 1))
    means = scored.groupBy("example_id", "option").agg(F.avg("loss").alias("loss"))
    best = means.groupBy("example_id").agg(F.min(F.struct("loss", "option")).alias("b")).select("example_id", F.col("b.option").alias("predicted"))
    return best.join(gold, "example_id").select("example_id", "predicted", (F.col("predicted") == F.col("gold")).alias("correct"))


def decide_completion(losses: DataFrame, spans: DataFrame) -> DataFrame:
    """example_id, correct: all predicted tokens of the span are the actual ones."""
    scored = losses.join(spans, "example_id").where((F.col("pos") >= F.col("start") - 1) & (F.col("pos") < F.col("end") - 1))
    return scored.groupBy("example_id").agg(F.bool_and(F.col("pred") == F.col("actual")).alias("correct"))


def roll_up(results: DataFrame, baselines: DataFrame) -> DataFrame:
    """One row for each label: n, accuracy, baseline, centered."""
    by_label = results.groupBy("label").agg(F.count("*").alias("n"), F.avg(F.col("correct").cast("double")).alias("accuracy"))
    own = by_label.join(baselines, "label", "left").withColumn("baseline", F.coalesce("baseline", F.lit(0.0)) / 100)
    return own.withColumn("centered", F.when(F.col("baseline") < 1, (F.col("accuracy") - F.col("baseline")) / (1 - F.col("baseline"))).otherwise(0.0))


def core_metric(results: DataFrame, baselines: DataFrame) -> DataFrame:
    """One row: core (mean of the centered scores of the labels seen), raw_accuracy, labels."""
    own = roll_up(results, baselines)
    return own.agg(F.coalesce(F.avg("centered"), F.lit(0.0)).alias("core"), F.coalesce(F.sum(F.col("accuracy") * F.col("n")) / F.sum("n"), F.lit(0.0)).alias("raw_accuracy"), F.count("*").alias("labels"))


def perplexity(losses: DataFrame, loss: str = "loss") -> DataFrame:
    """One row: the mean of batch losses, and its exponential (infinite from 20 on)."""
    mean = F.avg(loss)
    return losses.agg(mean.alias("mean_loss"), F.when(mean < 20, F.exp(mean)).otherwise(F.lit(float("inf"))).alias("perplexity"))


def masked_loss(tokens: DataFrame) -> DataFrame:
    return tokens.agg((F.sum(F.col("ce") * F.col("mask")) / F.greatest(F.lit(1), F.sum("mask"))).alias("loss"))


def top_k(logits: DataFrame, example: str, logit: str, k: int) -> DataFrame:
    """Logits below the k-th largest of their example become minus infinity; those equal to it stay."""
    own = Window.partitionBy(example)  # an example has as many rows as the vocabulary has tokens
    least = F.min(F.when(F.col("__r") <= k, F.col(logit))).over(own)
    ranked = logits.withColumn("__r", F.row_number().over(own.orderBy(F.desc(logit))))
    return ranked.withColumn(logit, F.when(F.col(logit) >= least, F.col(logit)).otherwise(F.lit(float("-inf")))).drop("__r")


def rank_mean(df: DataFrame, value: str, world: int) -> DataFrame:
    """One row: the sum over ranks of ``value`` over their number."""
    return df.agg((F.sum(value) / world).alias(value))
