"""Queries on evaluation, preference optimisation and rewards, over tables of predictions and per-token values.

The values stand in for a model's: they are arithmetic on the columns of other tables, so SQL gives the same."""

from pyspark.sql import functions as F

from textloom.functions import text
from textloom.operators import evals, preference, profile, rewards, synth
from textloom.plans.registry import CHATS, chats, query, table
from textloom.plans.conversations import STRIP, sequences


@query(
    """WITH l AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations),
    w AS (SELECT text = before AS same, list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) AS p, list_distinct(list_filter(regexp_split_to_array(lower(before), '\\s+'), lambda x: x <> '')) AS r FROM l WHERE before IS NOT NULL)
    SELECT count(*) AS n, round(avg(CASE WHEN same THEN 1 ELSE 0 END), 6) AS accuracy, round(avg(CASE WHEN len(list_intersect(p, r)) = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect(p, r)) / (len(p) + len(r)) END), 6) AS token_f1 FROM w"""
)
def wk_metrics(spark, sf_dir):
    own = chats(spark, sf_dir).select(F.posexplode("messages").alias("turn", "m"), "messages").where("turn > 0").select(F.col("m.content").alias("p"), F.get("messages", F.col("turn") - 1).content.alias("r"))
    out = profile.world_knowledge(own, text.token_f1(F.col("p"), F.col("r")), text.strip(F.col("p")) == text.strip(F.col("r")))
    return out.select("n", F.round("accuracy", 6).alias("accuracy"), F.round("token_f1", 6).alias("token_f1"))


@query("SELECT round(avg((quality = toxic)::INT), 6) AS accuracy, round(2.0::DOUBLE * count(*) FILTER (quality = 1 AND toxic = 1) / (count(*) FILTER (quality = 1) + count(*) FILTER (toxic = 1)), 6) AS f1 FROM labels")
def classif_accuracy_f1(spark, sf_dir):
    own = profile.classification(table(spark, sf_dir, "labels"), "quality", "toxic")
    return own.select(F.round("accuracy", 6).alias("accuracy"), F.round("f1", 6).alias("f1"))


@query("SELECT round(avg(l_discount * 30), 6) AS mean_loss, round(exp(avg(l_discount * 30)), 5) AS perplexity FROM lineitem")
def val_perplexity(spark, sf_dir):
    own = evals.perplexity(table(spark, sf_dir, "lineitem").select((F.col("l_discount") * 30).alias("loss")))
    return own.select(F.round("mean_loss", 6).alias("mean_loss"), F.round("perplexity", 5).alias("perplexity"))


@query("SELECT round(avg(exp(l_discount * 30)), 5) AS perplexity FROM lineitem")
def val_perplexity_meanexp(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").agg(F.round(F.avg(F.exp(F.col("l_discount") * 30)), 5).alias("perplexity"))


def token_table(spark, sf_dir):
    """A token for each line item: its position, loss and mask."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("example_id"), (F.col("l_linenumber") - 1).alias("pos"), (F.col("l_extendedprice") / 10000).alias("ce"), (-F.col("l_tax") * 10).alias("logp"),
        F.when(F.pmod("l_partkey", F.lit(3)) > 0, 1).otherwise(0).alias("mask"), F.col("l_quantity").alias("ret"), F.col("l_suppkey"),
    )


@query("SELECT round(sum(l_extendedprice / 10000 * (CASE WHEN l_partkey % 3 > 0 THEN 1 ELSE 0 END)) / greatest(1, sum(CASE WHEN l_partkey % 3 > 0 THEN 1 ELSE 0 END)), 6) AS loss FROM lineitem")
def masked_loss(spark, sf_dir):
    return evals.masked_loss(token_table(spark, sf_dir)).select(F.round("loss", 6).alias("loss"))


@query("SELECT l_orderkey AS example_id, round(sum(-l_tax * 10 * (CASE WHEN l_partkey % 3 > 0 THEN 1 ELSE 0 END)), 6) + 0.0 AS logprob FROM lineitem WHERE l_linenumber >= 2 GROUP BY l_orderkey")
def seq_logprob(spark, sf_dir):
    own = preference.sequence_logprob(token_table(spark, sf_dir), "example_id")
    return own.select("example_id", (F.round("logprob", 6) + F.lit(0.0)).alias("logprob"))


@query(
    """WITH v AS (SELECT 0.1::DOUBLE * (o_orderkey % 17 - o_custkey % 11) AS c, 0.1::DOUBLE * (o_custkey % 13 - o_orderkey % 7) AS r FROM orders)
    SELECT round(avg(ln(1 + exp(-(c - r)))), 6) AS loss, round(avg((c > r)::INT), 6) AS accuracy, round(avg(c - r), 6) AS margin FROM v"""
)
def dpo_loss(spark, sf_dir):
    mod = lambda c, n: F.pmod(c, F.lit(n)).cast("double")
    own = table(spark, sf_dir, "orders").select(mod("o_orderkey", 17).alias("policy_chosen"), mod("o_custkey", 11).alias("ref_chosen"), mod("o_custkey", 13).alias("policy_rejected"), mod("o_orderkey", 7).alias("ref_rejected"))
    return preference.dpo_loss(own).select(*[F.round(c, 6).alias(c) for c in ("loss", "accuracy", "margin")])


OUTPUTS = "(SELECT o_orderkey AS id, ['2.0', '2.001', '1,000', 'abc', '', 'ABC', '3'][1 + o_orderkey % 7] AS got, ['2.0', '2', '1000', 'abc', '7', 'abc'][1 + o_custkey % 6] AS want, o_custkey % 5 <> 0 AS ok FROM orders)"


def outputs(spark, sf_dir):
    pick = lambda values, c: F.get(F.array(*[F.lit(v) for v in values]), F.pmod(c, F.lit(len(values))).cast("int"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), pick(["2.0", "2.001", "1,000", "abc", "", "ABC", "3"], "o_orderkey").alias("got"), pick(["2.0", "2", "1000", "abc", "7", "abc"], "o_custkey").alias("want"), (F.pmod("o_custkey", F.lit(5)) != 0).alias("ok"), "o_orderpriority")


@query(
    f"""WITH v AS (SELECT id, got, want, ok, try_cast(replace(got, ',', '') AS DOUBLE) AS g, try_cast(replace(want, ',', '') AS DOUBLE) AS w FROM {OUTPUTS})
    SELECT id, round(CASE WHEN ok THEN 0.3 ELSE 0.0 END + CASE WHEN g IS NOT NULL AND w IS NOT NULL THEN 0.2 + CASE WHEN abs(g - w) <= 1e-3 * (abs(w) + 1e-8) THEN 0.5 ELSE 0.0 END
      WHEN ok AND lower(got) = lower(want) THEN 0.7 ELSE 0.0 END, 6)::DOUBLE AS reward FROM v"""
)
def reward_score(spark, sf_dir):
    return outputs(spark, sf_dir).select("id", rewards.score_stdout(F.col("got"), F.col("want"), F.col("ok")).alias("reward"))


@query(
    f"""WITH v AS (SELECT id, try_cast(n[len(n)] AS DOUBLE) AS g, try_cast(replace(want, ',', '') AS DOUBLE) AS w FROM (SELECT id, want, regexp_extract_all('It is ' || got, '-?[0-9]+\\.?[0-9]*') AS n FROM {OUTPUTS}))
    SELECT id, CASE WHEN g IS NULL THEN 0.0::DOUBLE WHEN coalesce(abs(g - w) <= 1e-3 * (abs(w) + 1e-8), false) THEN 1.0::DOUBLE ELSE 0.1::DOUBLE END AS reward FROM v"""
)
def reward_no_code(spark, sf_dir):
    return outputs(spark, sf_dir).select("id", rewards.score_text(F.concat(F.lit("It is "), "got"), F.col("want")).alias("reward"))


@query(
    f"""WITH v AS (SELECT o_orderpriority AS problem_type, CASE WHEN o_custkey % 5 <> 0 THEN (o_orderkey % 4) / 4.0::DOUBLE ELSE 0.0::DOUBLE END AS reward FROM orders)
    SELECT problem_type, count(*) AS n, round(avg(reward), 6) AS mean_reward, round(avg((reward > 0)::INT), 6) AS positive_rate FROM v GROUP BY problem_type"""
)
def rl_reward_by_type(spark, sf_dir):
    reward = F.when(F.pmod("o_custkey", F.lit(5)) != 0, F.pmod("o_orderkey", F.lit(4)) / 4).otherwise(0.0)
    own = rewards.by_problem_type(table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("problem_type"), reward.alias("reward")))
    return own.select("problem_type", "n", F.round("mean_reward", 6).alias("mean_reward"), F.round("positive_rate", 6).alias("positive_rate"))


@query("SELECT p_partkey, repeat('0', p_size - 1) || repeat('1', CAST(p_partkey % 9 AS INT)) || repeat('0', CAST(8 - p_partkey % 9 AS INT)) AS mask FROM part")
def rl_mask(spark, sf_dir):
    generated = F.pmod("p_partkey", F.lit(9)).cast("int")
    own = table(spark, sf_dir, "part").select("p_partkey", rewards.generation_mask(F.col("p_size"), generated, 8).alias("m"))
    return own.select("p_partkey", F.array_join(F.transform("m", lambda x: x.cast("string")), "").alias("mask"))


@query("SELECT p_partkey, round(list_sum(list_transform(range(0, p_size), lambda t: p_retailprice * pow(0.99::DOUBLE, p_size - 1 - t))) + 1e-7, 4) AS total, round(p_retailprice * pow(0.99::DOUBLE, p_size - 1) + 1e-7, 4) AS first FROM part")
def discounted_returns(spark, sf_dir):
    """The small shift keeps decimals that end in 5 from being rounded by an engine's last bit."""
    own = table(spark, sf_dir, "part").select("p_partkey", rewards.discounted_returns(F.col("p_retailprice"), F.col("p_size")).alias("r"))
    return own.select("p_partkey", F.round(F.aggregate("r", F.lit(0.0), lambda a, x: a + x) + 1e-7, 4).alias("total"), F.round(F.get("r", 0) + 1e-7, 4).alias("first"))


@query("SELECT c_custkey, round(c_acctbal - avg(c_acctbal) OVER (PARTITION BY c_custkey // 16), 6) + 0.0 AS advantage FROM customer")
def advantages(spark, sf_dir):
    own = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", F.floor(F.col("c_custkey") / 16).alias("batch"))
    return rewards.advantages(own, "c_acctbal", "batch").select("c_custkey", (F.round("advantage", 6) + F.lit(0.0)).alias("advantage"))


@query("SELECT round(sum(l_extendedprice / 10000 * m * l_quantity) / greatest(1, sum(m)), 5) AS loss FROM (SELECT *, CASE WHEN l_partkey % 3 > 0 THEN 1 ELSE 0 END AS m FROM lineitem)")
def rl_loss(spark, sf_dir):
    return rewards.policy_loss(token_table(spark, sf_dir)).select(F.round("loss", 5).alias("loss"))


# ------------------------------------------------------------------ benchmark evaluation


def items(spark, sf_dir):
    """Items with a few others as examples: those of the next two ids."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("query"), F.array("p_brand", "p_type").alias("choices"), F.pmod("p_partkey", F.lit(2)).cast("int").alias("gold"), F.concat(F.lit(" "), "p_name", F.lit("\n")).alias("context"), F.col("p_type").alias("continuation"))
    p = p.withColumn("context_options", F.col("choices"))
    ids = p.select("p_partkey", F.explode(F.array(F.col("p_partkey") + 1, F.col("p_partkey") + 2)).alias("other"))
    shot = p.select(F.col("p_partkey").alias("other"), F.struct("query", "choices", "gold", "context", "continuation", "context_options").alias("shot"))
    few = ids.join(shot, "other", "left").groupBy("p_partkey").agg(F.transform(F.sort_array(F.collect_list(F.when(F.col("shot").isNotNull(), F.struct("other", "shot")))), lambda x: x.shot).alias("fewshot"))
    return p.join(few, "p_partkey")


ITEMS = """WITH p AS (SELECT p_partkey, p_name AS query, [p_brand, p_type] AS choices, p_partkey % 2 AS gold, p_name AS context, p_type AS continuation FROM part),
  n AS (SELECT a.p_partkey AS p_partkey, coalesce(string_agg({shot} || chr(10) || chr(10), '' ORDER BY b.p_partkey), '') AS head FROM p a LEFT JOIN p b ON b.p_partkey IN (a.p_partkey + 1, a.p_partkey + 2) GROUP BY 1)
  SELECT p.p_partkey AS p_partkey, {first} AS first, {second} AS second FROM p JOIN n ON p.p_partkey = n.p_partkey"""


def two(df, prompts):
    return df.select("p_partkey", prompts.alias("p")).select("p_partkey", F.get("p", 0).alias("first"), F.get("p", 1).alias("second"))


@query(ITEMS.format(shot="b.query || ' ' || b.choices[1 + b.gold]", first="head || query || ' ' || choices[1]", second="head || query || ' ' || choices[2]"))
def render_mc(spark, sf_dir):
    return two(items(spark, sf_dir), evals.render_choices(F.col("fewshot"), F.col("query"), F.col("choices")))


@query(ITEMS.format(shot="b.choices[1 + b.gold] || ' ' || b.continuation", first="head || choices[1] || ' ' || continuation", second="head || choices[2] || ' ' || continuation"))
def render_schema(spark, sf_dir):
    return two(items(spark, sf_dir), evals.render_schema(F.col("fewshot"), F.col("context_options"), F.col("continuation")))


@query(ITEMS.format(shot=f"{STRIP.format('b.context')} || ' ' || b.continuation", first=STRIP.format("(head || " + STRIP.format("context") + ")"), second=f"head || {STRIP.format('context')} || ' ' || continuation"))
def render_lm(spark, sf_dir):
    return two(items(spark, sf_dir), evals.render_completion(F.col("fewshot"), F.col("context"), F.col("continuation")))


OPTIONS = "WITH o AS (SELECT p_partkey, list_transform(string_split(p_type, ' '), lambda w: length(w)) AS a, list_transform(string_split(p_type || ' ' || p_brand, ' '), lambda w: length(w)) AS b FROM part) SELECT p_partkey, "


def options(spark, sf_dir):
    w = lambda c: F.transform(F.split(c, " "), lambda x: F.length(x))
    return table(spark, sf_dir, "part").select("p_partkey", F.array(w(F.col("p_type")), w(F.concat("p_type", F.lit(" "), "p_brand"))).alias("t"))


def span(df, spans):
    return df.select("p_partkey", spans.alias("s")).select("p_partkey", *[F.get("s", i)[c].alias(f"{c}{i}") for i in (0, 1) for c in ("start", "end")])


@query(OPTIONS + "len(a) AS start0, len(a) AS end0, len(a) AS start1, len(b) AS end1 FROM o")
def score_span_mc(spark, sf_dir):
    return span(options(spark, sf_dir), evals.spans_choices(F.col("t")))


@query(
    OPTIONS
    + "len(a) - k AS start0, len(a) AS end0, len(b) - k AS start1, len(b) AS end1 FROM (SELECT *, CAST(coalesce(list_min(list_filter(range(0, len(a)), lambda i: a[len(a) - i] <> b[len(b) - i])), len(a)) AS BIGINT) AS k FROM o)"
)
def score_span_schema(spark, sf_dir):
    return span(options(spark, sf_dir), evals.spans_schema(F.col("t")))


@query(OPTIONS + "len(a) AS start, len(b) AS end FROM o")
def score_span_lm(spark, sf_dir):
    return options(spark, sf_dir).select("p_partkey", evals.span_completion(F.col("t")).alias("s")).select("p_partkey", "s.start", "s.end")


@query(
    f"""WITH {CHATS}, s AS (SELECT conv_id, list_transform(string_split(m[1].content, ' '), lambda w: length(w)) AS t FROM c)
    SELECT conv_id, CAST(least(20, len(t)) AS BIGINT) AS n, CAST(list_sum(t[greatest(1, len(t) - 19):]) AS BIGINT) AS total, CAST(5 - greatest(0, len(t) - 20) AS BIGINT) AS start, CAST(len(t) - greatest(0, len(t) - 20) AS BIGINT) AS end FROM s"""
)
def crop_left(spark, sf_dir):
    from textloom.operators.tokens import crop_left as crop

    own = sequences(spark, sf_dir).select("conv_id", F.get("seqs", 0).alias("t"))
    own = own.select("conv_id", crop(F.col("t"), 20, F.lit(5), F.size("t")).alias("c"))
    return own.select("conv_id", F.size("c.tokens").cast("long").alias("n"), F.aggregate("c.tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), "c.start", "c.end")


LOSSES = """WITH t AS (SELECT l_orderkey // 4 AS example_id, CAST(l_orderkey % 4 AS INT) AS option, l_linenumber - 1 AS pos, CAST(l_partkey % 50 AS DOUBLE) AS loss FROM lineitem),
  k AS (SELECT example_id, option, avg(loss) AS loss FROM t WHERE pos >= 0 AND pos < 3 GROUP BY 1, 2),
  b AS (SELECT example_id, arg_min(option, CAST(round(loss * 60) AS BIGINT) * 10 + option) AS predicted FROM k GROUP BY 1),
  r AS (SELECT example_id, predicted, predicted = example_id % 4 AS correct FROM b)
"""


def decided(spark, sf_dir):
    losses = table(spark, sf_dir, "lineitem").select(F.floor(F.col("l_orderkey") / 4).alias("example_id"), F.pmod("l_orderkey", F.lit(4)).cast("int").alias("option"), (F.col("l_linenumber") - 1).alias("pos"), F.pmod("l_partkey", F.lit(50)).cast("double").alias("loss"))
    examples = losses.select("example_id").distinct()
    spans = examples.select("example_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("option"), F.lit(1).alias("start"), F.lit(4).alias("end"))
    gold = examples.select("example_id", F.pmod("example_id", F.lit(4)).cast("int").alias("gold"))
    return evals.decide(losses, spans, gold)


@query(LOSSES + "SELECT example_id, predicted, correct FROM r")
def core_decide(spark, sf_dir):
    return decided(spark, sf_dir)


@query(
    LOSSES
    + """, l AS (SELECT 'task' || example_id % 5 AS label, correct FROM r), a AS (SELECT label, count(*) AS n, avg(correct::INT) AS acc FROM l GROUP BY 1),
    z AS (SELECT label, n, acc, CASE label WHEN 'task0' THEN 0.25::DOUBLE WHEN 'task1' THEN 1.0::DOUBLE WHEN 'task2' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS b FROM a)
    SELECT round(avg(CASE WHEN b < 1 THEN (acc - b) / (1 - b) ELSE 0 END), 6) AS core, round(sum(acc * n) / sum(n), 6) AS raw_accuracy, count(*) AS labels FROM z"""
)
def core_metric(spark, sf_dir):
    results = decided(spark, sf_dir).select(F.concat(F.lit("task"), F.pmod("example_id", F.lit(5))).alias("label"), "correct")
    baselines = spark.createDataFrame([("task0", 25.0), ("task1", 100.0), ("task2", 50.0), ("other", 10.0)], "label string, baseline double")
    own = evals.core_metric(results, baselines)
    return own.select(F.round("core", 6).alias("core"), F.round("raw_accuracy", 6).alias("raw_accuracy"), "labels")


@query(
    "SELECT i AS step, round((CASE WHEN i < 100 THEN (i + 1) / 100.0::DOUBLE WHEN i <= 800 THEN 1.0::DOUBLE ELSE (1000 - i) / 200.0::DOUBLE END) * 0.001::DOUBLE, 9) AS lr FROM range(1000) t(i)"
)
def lr_schedule(spark, sf_dir):
    return synth.lr_schedule(spark, 1000, 0.001).select("step", F.round("lr", 9).alias("lr"))
