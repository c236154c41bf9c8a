"""Queries on scans, splits, shards, mixing and sampling."""

from pyspark.sql import functions as F

from textloom.functions.numbers import LCG_M, hash32_sql, lcg, lcg_sql
from textloom.operators import mixing, splits
from textloom.plans.registry import CHATS, chats, query, table
from textloom.sources import readers, writers

WEIGHTS = {"smoltalk": 0.5, "lima": 0.2, "ultrachat_gen": 0.3}


def sharded(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", F.floor(F.col("doc_id") / 100).alias("shard"), F.floor(F.col("doc_id") % 100 / 10).alias("row_group"))


@query("SELECT true AS numbered, count(*) AS n_rows FROM documents")
def src_list_shards(spark, sf_dir):
    """Whether the files' numbers go from 0 without a gap in the order of their names, and the rows of all of them."""
    path = f"{sf_dir}/documents.parquet"
    files = readers.with_order(spark, path).groupBy("shard").agg(F.count("*").alias("n"), F.max("row").alias("last"), F.countDistinct("file_name").alias("names"))
    return files.agg((F.bool_and((F.col("names") == 1) & (F.col("last") + 1 == F.col("n"))) & (F.max("shard") + 1 == F.count("*"))).alias("numbered"), F.sum("n").alias("n_rows"))


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id // 100 < (SELECT max(doc_id // 100) FROM documents) AND (doc_id % 100) // 10 % 3 = 1")
def scan_strided(spark, sf_dir):
    train = splits.by_shard(sharded(spark, sf_dir), "shard", "last").where("split = 'train'")
    return readers.strided(train, "row_group", 3, 1).select("doc_id", "n_chars")


@query("SELECT doc_id, n_chars FROM documents WHERE source = 'src3'")
def scan_source_filter(spark, sf_dir):
    return readers.of_source(table(spark, sf_dir, "documents"), "src3").select("doc_id", "n_chars")


@query("SELECT doc_id, n_chars FROM documents WHERE source LIKE 'src1%'")
def scan_source_prefix(spark, sf_dir):
    return readers.of_source_prefix(table(spark, sf_dir, "documents"), "src1").select("doc_id", "n_chars")


@query("SELECT doc_id FROM documents WHERE doc_id % 4 = 1")
def stride_partition(spark, sf_dir):
    return splits.of_rank(table(spark, sf_dir, "documents"), "doc_id", 4, 1).select("doc_id")


@query("SELECT count(*) AS n FROM documents")
def profile_total_rows(spark, sf_dir):
    return table(spark, sf_dir, "documents").agg(F.count("*").alias("n"))


@query("SELECT source, count(*) AS n, count(*) / (SELECT count(*) FROM documents) AS fraction FROM documents GROUP BY source")
def profile_source_fraction(spark, sf_dir):
    own = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return own.crossJoin(F.broadcast(own.agg(F.sum("n").alias("total")))).select("source", "n", (F.col("n") / F.col("total")).alias("fraction"))


@query(
    "SELECT doc_id FROM documents WHERE (doc_id % 100) // 10 % 2 = 1 AND (doc_id // 100 > 3 OR (doc_id // 100 = 3 AND (doc_id % 100) // 10 >= (4 // 2 + 1) * 2 + 1))"
)
def resume_skip(spark, sf_dir):
    return readers.after_resume(sharded(spark, sf_dir), "shard", "row_group", 3, 4, 2, 1).select("doc_id")


@query("SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 300 AS shard, format('shard_{:05d}.parquet', (row_number() OVER (ORDER BY doc_id) - 1) // 300) AS file FROM documents")
def shard_assign(spark, sf_dir):
    own = writers.shard_assignment(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", rows=300)
    return own.select("doc_id", "shard", writers.shard_name(F.col("shard")).alias("file"))


@query("SELECT doc_id, CASE WHEN doc_id // 100 = (SELECT min(doc_id // 100) FROM documents) THEN 'val' ELSE 'train' END AS split FROM documents")
def split_first_shard(spark, sf_dir):
    return splits.by_shard(sharded(spark, sf_dir), "shard").select("doc_id", "split")


@query(
    """SELECT doc_id, CASE WHEN row_number() OVER (PARTITION BY doc_id // 100 ORDER BY doc_id) <= greatest(1, floor(0.1::DOUBLE * count(*) OVER (PARTITION BY doc_id // 100)))
    THEN 'val' ELSE 'train' END AS split FROM documents"""
)
def split_row_fraction(spark, sf_dir):
    return splits.by_fraction(sharded(spark, sf_dir), "shard", "doc_id", 0.1).select("doc_id", "split")


@query(
    """WITH s AS (SELECT DISTINCT CAST(r_regionkey AS BIGINT) AS shard FROM region), n AS (SELECT count(*) AS n FROM s)
    SELECT shard, CAST(x // 2 AS BIGINT) AS rank, CAST(x % 2 AS BIGINT) AS worker FROM s, n, range(8) t(x) WHERE shard % least(8, n) = x % least(8, n)"""
)
def shard_matrix(spark, sf_dir):
    shards = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("shard")).distinct()
    return splits.shard_owners(shards, 4, 2)


@query(
    "SELECT (rn - 1) // 8 AS batch, count(*) AS n, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS ids FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rn FROM documents) GROUP BY 1"
)
def batch_collate(spark, sf_dir):
    own = splits.batches(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 8, "doc_id")
    return own.select("batch", F.size("doc_id").cast("long").alias("n"), F.array_join(F.transform("doc_id", lambda x: x.cast("string")), ",").alias("ids"))


@query("SELECT t.i AS turn, r_name FROM range(17) t(i) JOIN (SELECT r_name, row_number() OVER (ORDER BY r_regionkey) - 1 AS k, count(*) OVER () AS n FROM region) ON t.i % n = k")
def limit_cycle(spark, sf_dir):
    return splits.cycled(table(spark, sf_dir, "region"), "r_regionkey", 17).select("turn", "r_name")


@query(f"SELECT doc_id, source FROM documents ORDER BY {lcg_sql('doc_id', 42)}, doc_id LIMIT 50")
def sample_n(spark, sf_dir):
    return mixing.sample(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", 50)


@query(f"SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {hash32_sql('((doc_id + 42) & 4294967295)')}, doc_id) AS r FROM documents) WHERE r <= 20")
def sample_each(spark, sf_dir):
    """Twenty documents of each source."""
    return mixing.sample_by(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 20)


@query(f"WITH {CHATS} SELECT conv_id, source, (row_number() OVER (ORDER BY {lcg_sql('conv_id', 42)}, conv_id) - 1) // 20 AS shard FROM c")
def build_conversations(spark, sf_dir):
    own = chats(spark, sf_dir)
    union = readers.union_columns(*[own.where(F.col("source") == s) for s in WEIGHTS])
    return writers.shard_assignment(union.select("conv_id", "source", lcg(F.col("conv_id"), 42).alias("h")), "h", "conv_id", rows=20).select("conv_id", "source", "shard")


MIX = f"""WITH d AS (SELECT i AS draw, CASE WHEN u < 0.5 THEN 'smoltalk' WHEN u < 0.7 THEN 'lima' ELSE 'ultrachat_gen' END AS source
  FROM (SELECT i, {lcg_sql('i', 7)} / {LCG_M} AS u FROM range(2000) t(i))),
k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY draw) - 1 AS k FROM d), {CHATS},
r AS (SELECT conv_id, source, row_number() OVER (PARTITION BY source ORDER BY conv_id) - 1 AS row, count(*) OVER (PARTITION BY source) AS n FROM c)
SELECT draw, k.source AS source, conv_id FROM k JOIN r ON k.source = r.source AND """


@query(MIX + "k % n = row")
def mix_weighted(spark, sf_dir):
    rows = chats(spark, sf_dir).select("conv_id", "source")
    return mixing.mixed(mixing.draws(spark, 2000, WEIGHTS, 7), rows, "conv_id").select("draw", "source", "conv_id")


@query(MIX + "(1 + k * 4) % n = row")
def mix_strided(spark, sf_dir):
    rows = chats(spark, sf_dir).select("conv_id", "source")
    return mixing.mixed(mixing.draws(spark, 2000, WEIGHTS, 7), rows, "conv_id", stride=4, offset=1).select("draw", "source", "conv_id")


@query(
    f"""WITH o AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY {lcg_sql('p_partkey', 1234)}, p_partkey) - 1 AS r, count(*) OVER (PARTITION BY p_brand) AS n FROM part)
    SELECT a.p_brand AS p_brand, a.p_partkey AS p_partkey, s.i AS shot, b.p_partkey AS other FROM o a, range(3) s(i), o b
    WHERE s.i < a.n - 1 AND a.p_brand = b.p_brand AND b.r = (a.r + 1 + s.i) % a.n"""
)
def fewshot_sample(spark, sf_dir):
    return mixing.few_shot(table(spark, sf_dir, "part"), "p_partkey", "p_brand", 3)


@query(
    """WITH k AS (SELECT lang, row_number() OVER (ORDER BY lang) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT lang FROM documents)),
    q AS (SELECT lang, 50 // n + CASE WHEN k < 50 % n THEN 1 ELSE 0 END AS quota FROM k),
    u AS (SELECT lang, source, doc_id, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS c FROM documents),
    p AS (SELECT lang, source, doc_id, row_number() OVER (PARTITION BY lang ORDER BY c, source) - 1 AS place FROM u)
    SELECT p.lang AS lang, source, doc_id, place FROM p JOIN q ON p.lang = q.lang WHERE place < quota"""
)
def roundrobin_quota(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("lang", "source", "doc_id")
    return mixing.round_robin(docs, "lang", "source", "doc_id", 50).select("lang", "source", "doc_id", "place")
