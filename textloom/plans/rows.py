"""Queries on splits, draws, prompts and padding."""

from pyspark.sql import functions as F

from textloom.functions import formats, numbers, text
from textloom.functions.numbers import LCG_M, MASK, hash32_sql, lcg_sql
from textloom.operators import evals, mixing, packing, preference, quantiles, rewards, splits, tokens
from textloom.plans.conversations import ALIGNED, LENGTHS, PAIRS, SHOWN, WORD_COUNT, lengths, pairs, shown, word_rows
from textloom.plans.registry import CHATS, chats, query, table
from textloom.plans.sources import WEIGHTS, sharded


@query("SELECT doc_id, split FROM documents, (VALUES ('train'), ('val')) t(split) WHERE doc_id // 100 = 2")
def split_fallback(spark, sf_dir):
    """A lone shard is both."""
    return splits.by_shard(sharded(spark, sf_dir).where("shard = 2"), "shard", fallback=True).select("doc_id", "split")


@query("SELECT doc_id, CASE WHEN lang IN ('en', 'fr') THEN 'train' ELSE 'test' END AS split FROM documents WHERE lang IN ('en', 'fr', 'de')")
def split_by_file(spark, sf_dir):
    own = table(spark, sf_dir, "documents").select("doc_id", F.concat("lang", F.lit(".parquet")).alias("file"))
    return splits.by_file(own, "file", {"train": ["en.parquet", "fr.parquet"], "test": ["de.parquet"]}).select("doc_id", "split")


@query(
    """WITH s AS (SELECT DISTINCT CAST(r_regionkey AS BIGINT) AS shard FROM region)
    SELECT shard, CAST(x // 2 AS BIGINT) AS rank, CAST(x % 2 AS BIGINT) AS worker FROM s, range(8) t(x) WHERE shard % 8 = x"""
)
def shard_matrix_strict(spark, sf_dir):
    shards = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("shard")).distinct()
    return splits.shard_owners(shards, 4, 2, share=False)


def shuffle_sql(key: str, seed: int, source: str) -> str:
    return f"SELECT {key}, row_number() OVER (ORDER BY {hash32_sql(f'({key} + {seed}) & {MASK}')}, {key}) - 1 AS place FROM {source}"


@query(shuffle_sql("doc_id", 42, "documents"))
def shuffle_rows(spark, sf_dir):
    return splits.shuffled(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 42)


@query(shuffle_sql("shard", 7, "(SELECT DISTINCT doc_id // 100 AS shard FROM documents)"))
def shuffle_files(spark, sf_dir):
    return splits.shuffled(sharded(spark, sf_dir).select("shard").distinct(), "shard", 7)


@query(
    f"""WITH d AS (SELECT i AS batch, CASE WHEN u < 0.5 THEN 'smoltalk' WHEN u < 0.7 THEN 'lima' ELSE 'ultrachat_gen' END AS source FROM (SELECT i, {lcg_sql('i', 11)} / {LCG_M} AS u FROM range(300) t(i))),
  k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY batch) - 1 AS k FROM d), e AS (SELECT batch, source, batch * 4 + j AS draw, k * 4 + j AS k FROM k, range(4) t(j)), {CHATS},
  r AS (SELECT conv_id, source, row_number() OVER (PARTITION BY source ORDER BY conv_id) - 1 AS row, count(*) OVER (PARTITION BY source) AS n FROM c)
SELECT draw, batch, e.source AS source, conv_id FROM e JOIN r ON e.source = r.source AND k % n = row"""
)
def mix_batches(spark, sf_dir):
    rows = chats(spark, sf_dir).select("conv_id", "source")
    return mixing.mixed(mixing.batch_draws(spark, 300, 4, WEIGHTS, 11), rows, "conv_id").select("draw", "batch", "source", "conv_id")


@query("SELECT doc_id, source, CASE WHEN row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 100 // (SELECT count(DISTINCT source) FROM documents) THEN 'val' ELSE 'train' END AS split FROM documents")
def pref_quota(spark, sf_dir):
    return preference.quota_split(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", 100)


@query(PAIRS + f"SELECT conv_id, 'feedback' AS source, {SHOWN.format('chosen')} AS chosen, {SHOWN.format('rejected')} AS rejected, (row_number() OVER (ORDER BY conv_id) - 1) // 50 AS shard FROM p")
def pref_tagged(spark, sf_dir):
    from textloom.sources.writers import shard_assignment

    own = preference.tagged_pairs(pairs(spark, sf_dir).drop("source"), "feedback")
    return shard_assignment(own, "conv_id", rows=50).select("conv_id", "source", shown(F.col("chosen")).alias("chosen"), shown(F.col("rejected")).alias("rejected"), "shard")


@query(
    """SELECT item_id, 'Write the rest of this Python function.' || chr(10) || chr(10) || text AS question,
    text || '  pass' || chr(10) || chr(10) || 'def check(f):' || chr(10) || '  f()' || chr(10) || 'check(f' || item_id || ')' AS test_code FROM benchmark"""
)
def fmt_solved_prompt(spark, sf_dir):
    p = formats.solved_prompt(F.col("text"), F.lit("  pass"), F.concat(F.lit("f"), "item_id"), F.lit("def check(f):\n  f()"))
    return table(spark, sf_dir, "benchmark").select("item_id", p.alias("p")).select("item_id", "p.*")


@query("SELECT doc_id, trim(text) || ' and more' AS bare FROM documents")
def strip_special(spark, sf_dir):
    marked = F.concat(F.lit(" <|user|>"), "text", F.lit(" <|pad|>and more<|assistant|>\n"))
    return table(spark, sf_dir, "documents").select("doc_id", text.strip_special(marked).alias("bare"))


CHAT_BYTES = f"WITH {CHATS}, n AS (SELECT conv_id, m, len(m) + list_sum(list_transform(m, lambda x: strlen(x.content))) AS n FROM c) "


@query(CHAT_BYTES + "SELECT conv_id, CAST(n + 2 AS BIGINT) AS n, 50257 AS first, 50256 AS last FROM n")
def conversation_ids(spark, sf_dir):
    own = chats(spark, sf_dir).select("conv_id", F.transform(tokens.tokenize_conversation(F.col("messages"), "all"), lambda p: p.t).alias("t"))
    return own.select("conv_id", F.size("t").cast("long").alias("n"), F.get("t", 0).alias("first"), F.element_at("t", -1).alias("last"))


@query(CHAT_BYTES + "SELECT conv_id, CAST(n + 2 AS BIGINT) AS n, 50257 AS first, 50260 AS last FROM n")
def encode_chat(spark, sf_dir):
    own = chats(spark, sf_dir).select("conv_id", tokens.encode_chat(F.col("messages")).alias("t"))
    return own.select("conv_id", F.size("t").cast("long").alias("n"), F.get("t", 0).alias("first"), F.element_at("t", -1).alias("last"))


@query("SELECT item_id, strlen(text) + 3 AS n, 50257 AS first, 50260 AS last, strlen(text) AS bare FROM benchmark")
def prompt_ids(spark, sf_dir):
    own = table(spark, sf_dir, "benchmark").select("item_id", tokens.prompt_ids(F.col("text")).alias("t"), tokens.bytes_ids(F.col("text")).alias("b"))
    return own.select("item_id", F.size("t").cast("long").alias("n"), F.get("t", 0).alias("first"), F.element_at("t", -1).alias("last"), F.size("b").cast("long").alias("bare"))


@query(f"SELECT doc_id, least(len(t), 100) AS n, CAST(list_sum(t[1:100]) AS BIGINT) AS total FROM (SELECT doc_id, {LENGTHS} AS t FROM documents)")
def tokenize_truncated(spark, sf_dir):
    own = table(spark, sf_dir, "documents").select("doc_id", tokens.truncated(lengths(), 100).alias("t"))
    return own.select("doc_id", F.size("t").cast("long").alias("n"), F.aggregate("t", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query(f"SELECT doc_id, doc_id // 8 AS batch, max(len(t)) OVER (PARTITION BY doc_id // 8) AS width, max(len(t)) OVER (PARTITION BY doc_id // 8) - len(t) AS n_pad FROM (SELECT doc_id, {LENGTHS} AS t FROM documents)")
def pad_to_longest(spark, sf_dir):
    own = table(spark, sf_dir, "documents").select("doc_id", F.floor(F.col("doc_id") / 8).alias("batch"), lengths().alias("t"))
    out = tokens.pad_to_longest(own, "batch", "t", -1)
    return out.where(F.size("t") == F.col("width")).select("doc_id", "batch", F.col("width").cast("long").alias("width"), F.size(F.filter("t", lambda x: x == -1)).cast("long").alias("n_pad"))


@query(ALIGNED.format(size=2048, length=WORD_COUNT) + "SELECT stream, count(*) AS n_seqs, 2048 - CAST(sum(n) AS BIGINT) AS n_pad FROM f WHERE chunk = 0 GROUP BY stream")
def pack_first_chunk(spark, sf_dir):
    own = word_rows(spark, sf_dir).withColumn("stream", F.floor(F.col("doc_id") / 500))
    return packing.first_chunk(own, "t", "m", "stream", ["doc_id"], 2048).select("stream", "n_seqs", "n_pad")


@query(f"WITH {CHATS} SELECT conv_id, list_transform(m, lambda x: x.role || '@' || source)[1] AS first, len(m) AS n FROM c")
def zip_columns(spark, sf_dir):
    own = chats(spark, sf_dir).select("conv_id", F.transform("messages", lambda x: x.role).alias("role"), F.array_repeat("source", F.size("messages")).alias("of"))
    return own.select("conv_id", F.transform(F.arrays_zip("role", "of"), lambda z: F.concat(z.role, F.lit("@"), z.of))[0].alias("first"), F.size("role").cast("long").alias("n"))


@query("SELECT o_orderpriority, round(sum(p) / 4, 6) AS loss FROM (SELECT o_orderpriority, o_orderkey % 4 AS rank, avg(o_totalprice::DOUBLE) AS p FROM orders GROUP BY ALL) GROUP BY o_orderpriority HAVING o_orderpriority = '1-URGENT'")
def rank_mean(spark, sf_dir):
    own = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").groupBy("o_orderpriority", F.pmod("o_orderkey", F.lit(4)).alias("rank")).agg(F.avg(F.col("o_totalprice").cast("double")).alias("loss"))
    return evals.rank_mean(own, "loss", 4).select(F.lit("1-URGENT").alias("o_orderpriority"), F.round("loss", 6).alias("loss"))


@query("SELECT source, CAST(median(n_chars) AS DOUBLE) AS median, count(*) AS n FROM documents GROUP BY source")
def order_median(spark, sf_dir):
    own = table(spark, sf_dir, "documents").select("source", "n_chars")
    return quantiles.medians(own, "n_chars", ["source"]).join(own.groupBy("source").agg(F.count("*").alias("n")), "source")


@query("SELECT l_returnflag, CAST(median(l_extendedprice::DOUBLE) AS DOUBLE) AS median FROM lineitem GROUP BY l_returnflag")
def median_prices(spark, sf_dir):
    """Middle values of columns with almost as many values as rows."""
    return quantiles.medians(table(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_returnflag"])


@query(
    """SELECT l_orderkey, l_linenumber, CASE WHEN price >= least THEN price ELSE '-inf'::DOUBLE END AS price FROM (
    SELECT l_orderkey, l_linenumber, l_extendedprice::DOUBLE AS price, min(CASE WHEN r <= 2 THEN l_extendedprice::DOUBLE END) OVER (PARTITION BY l_orderkey) AS least
    FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC) AS r FROM lineitem))""".replace("SELECT l_orderkey, l_linenumber, CASE WHEN price >= least THEN price ELSE '-inf'::DOUBLE END AS price", "SELECT l_orderkey, l_linenumber, price >= least AS kept, CASE WHEN price >= least THEN price ELSE 0 END AS price")
)
def topk_filter(spark, sf_dir):
    own = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").cast("double").alias("price"))
    out = evals.top_k(own, "l_orderkey", "price", 2)
    kept = F.col("price") > float("-inf")
    return out.select("l_orderkey", "l_linenumber", kept.alias("kept"), F.when(kept, F.col("price")).otherwise(0.0).alias("price"))


@query("SELECT n_nationkey, coalesce(r_name, 'none') AS region FROM nation LEFT JOIN region ON n_regionkey = r_regionkey AND r_regionkey < 3")
def map_lookup(spark, sf_dir):
    """A lookup in a map with a default, where the map has a row for each region."""
    regions = table(spark, sf_dir, "region").where("r_regionkey < 3").agg(F.map_from_entries(F.collect_list(F.struct("r_regionkey", "r_name"))).alias("m"))  # one row
    return table(spark, sf_dir, "nation").crossJoin(F.broadcast(regions)).select("n_nationkey", F.coalesce(F.try_element_at("m", F.col("n_regionkey")), F.lit("none")).alias("region"))


@query("SELECT o_orderkey, round_even(o_orderkey / 4, 0) AS whole, round_even(o_orderkey / 8, 2) AS places FROM orders")
def half_even(spark, sf_dir):
    """Halves go to the even neighbour."""
    return table(spark, sf_dir, "orders").select("o_orderkey", numbers.half_even(F.col("o_orderkey") / 4).alias("whole"), numbers.half_even(F.col("o_orderkey") / 8, 2).alias("places"))


@query("SELECT l_orderkey AS example_id, bool_and(l_suppkey % 3 = l_partkey % 3) AS correct FROM lineitem WHERE l_linenumber IN (1, 2) GROUP BY l_orderkey")
def core_decide_completion(spark, sf_dir):
    """All tokens predicted in the span from 2 to 4: the losses at positions 1 and 2."""
    own = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("example_id"), F.col("l_linenumber").alias("pos"), (F.col("l_suppkey") % 3).alias("pred"), (F.col("l_partkey") % 3).alias("actual"))
    spans = own.select("example_id", F.lit(2).alias("start"), F.lit(4).alias("end")).distinct()
    return evals.decide_completion(own, spans)


@query("SELECT p_partkey, round(CASE WHEN p_partkey % 5 > 0 AND p_partkey % 7 > 0 THEN 0.3::DOUBLE + 0.7::DOUBLE * (p_size % 4) / 4 ELSE 0 END, 6) AS reward FROM part")
def reward_tests(spark, sf_dir):
    own = rewards.score_tests(F.col("p_partkey") % 5 > 0, F.col("p_partkey") % 7 > 0, F.col("p_size") % 4 / 4)
    return table(spark, sf_dir, "part").select("p_partkey", F.round(own, 6).alias("reward"))
