"""Generated data: worked calculator problems and conversations that change topic.

All draws are whole-number hashes of the seed, the row's number and the draw's number, as Columns: a row is the same wherever and in whatever order it
is made, and any engine with 64-bit arithmetic can make it too.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions.messages import MESSAGES, estimate_tokens, ua_pairs
from textloom.functions.numbers import drawn, hash32, number_text
from textloom.functions.text import last_number
from textloom.operators.mixing import pick_source
from textloom.operators.ordering import row_numbers

# Percent of problems with a slip, the system prompt, the offset of the validation seed.
SLIP_PERCENT = 20
SYSTEM_PROMPT = "You are a helpful assistant."
VALIDATION_SEED = 10_000

TYPES = ["arithmetic", "statistics", "conversion"]
READINGS = [4, 5, 8]  # numbers of readings whose means have at most three decimals
UNITS = [("hours", "minutes", 60), ("days", "hours", 24), ("weeks", "days", 7), ("dozens", "pieces", 12), ("metres", "centimetres", 100), ("kilograms", "grams", 1000)]
DRAWS = 16


def draws(row: Column, seed: int, n: int) -> Column:
    """An array of n draws, each from 0 to 2**32 - 1."""
    own = hash32(row.bitwiseAND(F.lit(0xFFFFFFFF)).bitwiseXOR(hash32(F.shiftright(row, 32) + F.lit(seed))))
    return F.transform(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")), lambda k: hash32((own + k * F.lit(2654435769)).bitwiseAND(F.lit(0xFFFFFFFF))))


def text_of(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def calculator_problems(spark: SparkSession, n: int, seed: int = 42, rank: int = 0) -> DataFrame:
    """n problems: question, response, expected_output, has_error, problem_type, calculator_code.

    A response has its steps, what they come to, a program, and what the program says. In one of five a step is off by 5 to 15 percent (2 at least),
    later steps go on with the wrong number, and the response ends with the program's."""
    rows = spark.range(n).withColumn("r", draws(F.col("id"), seed + rank, DRAWS))
    pick = lambda k, lo, hi: drawn(F.get("r", k), hi - lo + 1) + lo
    wrong = F.col("has_error")
    rows = rows.withColumns({"type": pick(0, 0, 2), "has_error": pick(1, 0, 99) < SLIP_PERCENT, "sign": pick(2, 0, 1) * 2 - 1, "percent": pick(3, 5, 15)})
    off = lambda v, at: v + F.when(wrong & at, F.col("sign") * F.greatest(F.lit(2), F.floor(F.abs(v) * F.col("percent") / 100))).otherwise(0)

    a, b, c, d, slip = pick(4, 20, 90), pick(5, 2, 19), pick(6, 2, 9), pick(7, 1, 40), pick(8, 0, 2)
    shelf = off(a + b, slip == 0)
    all_ = off(shelf * c, slip == 1)
    left = off(all_ - d, slip == 2)
    arithmetic = F.struct(
        text_of("A depot has ", a, " crates on each shelf and puts ", b, " more on each. There are ", c, " shelves. It sends ", d, " crates away. How many crates stay?").alias("question"),
        F.array(text_of("One shelf: ", a, " + ", b, " = ", shelf), text_of("All shelves: ", shelf, " * ", c, " = ", all_), text_of("Left over: ", all_, " - ", d, " = ", left)).alias("steps"),
        left.cast("string").alias("told"), ((a + b) * c - d).cast("string").alias("right"), text_of("shelf = ", a, " + ", b, "\nprint(shelf * ", c, " - ", d, ")").alias("code"),
    )

    size = F.get(F.array(*[F.lit(x).cast("long") for x in READINGS]), pick(4, 0, 2).cast("int"))
    readings = F.transform(F.slice("r", F.lit(6), size.cast("int")), lambda x: drawn(x, 90) + 10)
    total = F.aggregate(readings, F.lit(0).cast("long"), lambda s, x: s + x)
    said = off(total, F.lit(True))
    listed = F.array_join(F.transform(readings, lambda x: x.cast("string")), ", ")
    statistics = F.struct(
        text_of("A gauge showed these values: ", listed, ". What is their mean?").alias("question"),
        F.array(text_of("The ", size, " values add up to ", said, "."), text_of(said, " / ", size, " = ", number_text(said / size))).alias("steps"),
        number_text(said / size).alias("told"), number_text(total / size).alias("right"), text_of("values = [", listed, "]\nprint(sum(values) / len(values))").alias("code"),
    )

    which, amount = pick(4, 0, len(UNITS) - 1).cast("int"), pick(5, 2, 250)
    large, small, factor = (F.get(F.array(*[F.lit(u[k]) for u in UNITS]), which) for k in range(3))
    product = off(amount * factor, F.lit(True))
    conversion = F.struct(
        text_of("How many ", small, " are ", amount, " ", large, "?").alias("question"),
        F.array(text_of("From ", large, " to ", small, " the factor is ", factor, "."), text_of(amount, " * ", factor, " = ", product)).alias("steps"),
        product.cast("string").alias("told"), (amount * factor).cast("string").alias("right"), text_of("print(", amount, " * ", factor, ")").alias("code"),
    )

    made = rows.withColumn("p", F.when(F.col("type") == 0, arithmetic).when(F.col("type") == 1, statistics).otherwise(conversion))
    verdict = F.when(wrong, text_of("The program prints ", F.col("p.right"), " and not ", F.col("p.told"), ", so a step above is wrong. Result: ", F.col("p.right"))).otherwise(text_of("The program prints the same. Result: ", F.col("p.right")))
    response = text_of(F.array_join("p.steps", "\n"), "\nBy hand: ", F.col("p.told"), "\n\n```python\n", F.col("p.code"), "\n```\n\n", verdict)
    name = F.get(F.array(*[F.lit(t) for t in TYPES]), F.col("type").cast("int"))
    return made.select("p.question", response.alias("response"), F.col("p.right").alias("expected_output"), "has_error", name.alias("problem_type"), F.col("p.code").alias("calculator_code"))


def quality_counters(problems: DataFrame) -> DataFrame:
    """For each problem_type: n, perfect (responses that end with the expected number), mean_reward (their share), error_rate."""
    right = last_number(F.col("response")).try_cast("double") == F.col("expected_output").try_cast("double")
    own = problems.groupBy("problem_type").agg(F.count("*").alias("n"), F.sum(F.when(right, 1).otherwise(0)).alias("perfect"), F.avg(F.col("has_error").cast("double")).alias("error_rate"))
    return own.withColumn("mean_reward", F.col("perfect") / F.col("n"))


def topic_switches(pool: DataFrame, order: str, n: int, weights: dict[str, float], *, p_resume: float = 0.5, p_system: float = 0.5, budget: int = 2048, seed: int = 42) -> DataFrame:
    """Conversations whose pairs come from different ones of the same source: conv, source, messages, n_pairs.

    ``pool`` has source and messages. A conversation is made of stretches: each goes on in a drawn conversation of the pool, from its first pair, with
    p_resume after each pair. Pairs are kept while the estimate stays in the budget; a conversation without a pair is left out. There are as many stretches
    as the shortest pair could fill the budget. Stretches meet the pool by an equi-join on (source, number), first with the lengths of pairs alone, so texts
    move only for pairs that stay.
    """
    spark = pool.sparkSession
    cost = lambda p: estimate_tokens(F.array(p.user, p.assistant)) - 2
    usable = pool.withColumn("pairs", ua_pairs(F.col("messages"))).where(F.size("pairs") > 0).select("source", order, "pairs", F.transform("pairs", cost).alias("costs"))
    numbered = row_numbers(usable, [order], "k", ["source"])
    sizes = numbered.groupBy("source").agg(F.count("*").alias("n"))
    least = numbered.agg(F.min(F.array_min("costs"))).first()[0]  # one row
    stretches = 1 + budget // max(1, least or 1)
    resumes = 0 if p_resume <= 0 else math.ceil(-32 / math.log2(p_resume)) if p_resume < 1 else budget  # longer ones are below the draws' resolution
    conv = spark.range(n).withColumnRenamed("id", "conv")
    first = draws(F.col("conv"), seed, 2)
    conv = conv.select("conv", pick_source(F.get(first, 0) / 2**32, weights).alias("source"), (F.get(first, 1) / 2**32 < p_system).alias("has_system"))
    conv = conv.withColumn("head", F.when(F.col("has_system"), F.array(F.struct(F.lit("system").alias("role"), F.lit(SYSTEM_PROMPT).alias("content")))).otherwise(F.array().cast(MESSAGES)))
    each = conv.select("conv", "source", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(stretches - 1).cast("long"))).alias("stretch"))
    each = each.withColumn("r", draws(F.col("conv") * stretches + F.col("stretch"), seed + 1, 2))
    steps = F.array(*[F.lit(int(p_resume**t * 2**32)) for t in range(1, resumes + 1)]).cast("array<bigint>")
    length = 1 + F.size(F.filter(steps, lambda x: F.get("r", 1) < x))
    each = each.join(sizes, "source").select("conv", "source", "stretch", drawn(F.get("r", 0), F.col("n")).alias("k"), length.alias("length"))
    costs = each.join(numbered.select("source", "k", "costs"), ["source", "k"]).select("conv", "source", "stretch", "k", F.posexplode(F.slice("costs", F.lit(1), F.col("length"))).alias("place", "cost"))
    used = F.sum("cost").over(Window.partitionBy("conv").orderBy("stretch", "place"))
    room = costs.withColumn("used", used).join(conv.select("conv", estimate_tokens(F.col("head")).alias("start")), "conv").where(F.col("start") + F.col("used") <= budget)
    kept = room.groupBy("conv", "source", "stretch", "k").agg(F.count("*").cast("int").alias("take"))
    texts = kept.join(numbered.select("source", "k", "pairs"), ["source", "k"]).select("conv", F.struct("stretch", F.slice("pairs", F.lit(1), F.col("take")).alias("pairs")).alias("s"))
    rows = texts.groupBy("conv").agg(F.flatten(F.transform(F.sort_array(F.collect_list("s")), lambda x: x.pairs)).alias("pairs"))
    body = F.flatten(F.transform("pairs", lambda p: F.array(p.user, p.assistant)))
    return rows.join(conv, "conv").select("conv", "source", F.concat("head", body).alias("messages"), F.size("pairs").cast("long").alias("n_pairs"))


def lr_schedule(spark: SparkSession, steps: int, peak: float, warmup: float = 0.1, warmdown: float = 0.2, floor: float = 0.0) -> DataFrame:
    """step, lr: linear rise, constant, linear fall to ``floor`` of the peak."""
    up, down = max(1, round(steps * warmup)), max(1, round(steps * warmdown))
    s = F.col("id")
    factor = F.when(s < up, (s + 1) / up).when(s <= steps - down, F.lit(1.0)).otherwise((steps - s) / down * (1 - floor) + floor)
    return spark.range(steps).select(F.col("id").alias("step"), (factor * peak).alias("lr"))
