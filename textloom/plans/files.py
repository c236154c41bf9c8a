"""Queries that write small tables in a reader's format and read them again."""

import io
import zipfile

from pyspark.sql import functions as F

from textloom.plans.registry import CHATS, chats, query, table
from textloom.sources import fetch, readers, suites, writers
from textloom.sources.scratch import put, scratch


@query("SELECT 'q' || item_id AS query, ['a', item_id::VARCHAR] AS choices, 1 AS gold, text AS context FROM benchmark".replace("['a', item_id::VARCHAR] AS choices", "'a,' || item_id AS choices"))
def src_json_lines(spark, sf_dir):
    path = scratch(spark, "jsonl")
    own = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("q"), "item_id").alias("query"), F.array(F.lit("a"), F.col("item_id").cast("string")).alias("choices"), F.lit(1).alias("gold"), F.col("text").alias("context"))
    own.write.json(path)
    return readers.read_json_lines(spark, path).select("query", F.array_join("choices", ",").alias("choices"), "gold", "context")


@query("SELECT 'task ' || p_partkey AS label, p_size / 2.0::DOUBLE AS baseline FROM part")
def src_baselines(spark, sf_dir):
    path = scratch(spark, "csv")
    table(spark, sf_dir, "part").select(F.concat(F.lit("task "), "p_partkey").alias("Eval Task"), (F.col("p_size") / 2.0).alias("Random baseline")).write.option("header", True).csv(path)
    return readers.read_baselines(spark, path)


TASKS = """
icl_tasks:
- {label: first, icl_task_type: multiple_choice, dataset_uri: a/b.jsonl, num_fewshot: [10], continuation_delimiter: ": "}
- {label: second, icl_task_type: schema, dataset_uri: c.jsonl, num_fewshot: [0, 5]}
"""


@query("SELECT * FROM (VALUES ('first', 'multiple_choice', 'a/b.jsonl', 10, ': '), ('second', 'schema', 'c.jsonl', 0, ' ')) t(label, task_type, dataset_uri, num_fewshot, delimiter)")
def src_task_config(spark, sf_dir):
    return readers.read_task_config(spark, TASKS)


@query("SELECT r_regionkey, r_name FROM region")
def src_skip_unreadable(spark, sf_dir):
    """A folder in which a shard can't be read: its rows are left out, the others come."""
    path = scratch(spark, "shards")
    own = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    own.write.parquet(path)
    put(spark, f"{path}/part-99999-broken.parquet", "not a Parquet file")
    return readers.read_shards(spark, path, own.schema, skip_unreadable=True)


@query("SELECT count(*) AS n_rows, true AS bounded, true AS in_order FROM documents")
def sink_shards(spark, sf_dir):
    """Documents written in shards of at most 300 rows and read with file order: all rows, no file above the bound, each with a range of ids of its own."""
    path = scratch(spark, "shards")
    writers.write_shards(table(spark, sf_dir, "documents").select("doc_id", "source"), path, "doc_id", rows=300)
    files = readers.read_shards(spark, path).select("doc_id", F.col("_metadata.file_name").alias("f")).groupBy("f").agg(F.count("*").alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
    return files.agg(F.sum("n").alias("n_rows"), F.bool_and(F.col("n") <= 300).alias("bounded"), (F.max("hi") - F.min("lo") + 1 >= F.sum(F.col("hi") - F.col("lo") + 1)).alias("in_order"))


@query("SELECT n_nationkey, n_name, 1 AS n_files FROM nation")
def sink_single(spark, sf_dir):
    path = scratch(spark, "single")
    writers.write_single(table(spark, sf_dir, "nation").select("n_nationkey", "n_name").repartition(3), path)
    own = readers.read_shards(spark, path)
    return own.select("*", F.lit(len(own.inputFiles())).alias("n_files"))


@query("SELECT r_regionkey, r_name FROM region")
def sink_once(spark, sf_dir):
    """A second write to the same place does nothing."""
    path = scratch(spark, "once")
    own = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    for rows in (own, own.limit(1)):
        writers.write_once(rows, path)
    return readers.read_shards(spark, path)


@query("SELECT s AS step, 'rows_' || o_orderpriority AS metric, count(*)::DOUBLE * s AS value FROM orders, range(1, 3) t(s) GROUP BY s, o_orderpriority")
def sink_metrics(spark, sf_dir):
    path = scratch(spark, "metrics")
    own = table(spark, sf_dir, "orders").groupBy(F.concat(F.lit("rows_"), "o_orderpriority").alias("metric")).agg(F.count("*").alias("n"))
    for step in (1, 2):
        writers.append_metrics(own.select("metric", (F.col("n") * step).alias("value")), path, step)
    return spark.read.parquet(path)


@query("SELECT format('{:<18}', o_orderpriority) || ' | ' || format('{:>8}', count(*)) || ' | ' || printf('%10.2f', avg(o_totalprice::DOUBLE)) AS line FROM orders GROUP BY o_orderpriority")
def report_lines(spark, sf_dir):
    own = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.avg(F.col("o_totalprice").cast("double")).alias("mean"))
    return writers.report_lines(own, o_orderpriority="%-18s", n="%8d", mean="%10.2f")


@query("SELECT p_name AS question, p_brand AS subject FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_name, NULL FROM part WHERE p_partkey % 2 = 1")
def src_unify(spark, sf_dir):
    """Two tables of questions, one nested in a column, the other without a subject."""
    own = table(spark, sf_dir, "part")
    nested = own.where("p_partkey % 2 = 0").select(F.struct(F.col("p_name").alias("question"), F.col("p_brand").alias("subject")).alias("train"))
    return readers.union_columns(readers.flattened(nested), own.where("p_partkey % 2 = 1").select(F.col("p_name").alias("question")))


@query(f"WITH {CHATS} SELECT conv_id, len(m) AS n FROM c WHERE source = 'lima' AND conv_id % 5 <> 0")
def scan_conversations(spark, sf_dir):
    own = chats(spark, sf_dir).withColumn("messages", F.when(F.col("conv_id") % 5 != 0, F.col("messages")))
    return readers.conversations_of(own, "lima").select("conv_id", F.size("messages").cast("long").alias("n"))


@query("SELECT doc_id, n_chars FROM documents ORDER BY doc_id LIMIT 137")
def scan_first_rows(spark, sf_dir):
    return readers.first_rows(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id", 137)


@query(f"SELECT {len(suites.COMPLETIONS)} AS completions, {len(suites.KNOWLEDGE)} AS knowledge, {len(suites.CONVERSATIONS)} AS conversations, {sum(len(m) for m in suites.CONVERSATIONS)} AS messages")
def prompt_suites(spark, sf_dir):
    count = lambda df, name: df.agg(F.count("*").cast("int").alias(name))
    own = suites.conversations(spark).agg(F.count("*").cast("int").alias("conversations"), F.sum(F.size("messages")).cast("int").alias("messages"))
    return count(suites.completions(spark), "completions").crossJoin(count(suites.knowledge(spark), "knowledge")).crossJoin(own)


@query("SELECT 'region' AS name, false AS skipped, count(*) AS n_rows FROM region UNION ALL SELECT 'region', true, count(*) FROM region UNION ALL SELECT 'nation', false, count(*) FROM nation UNION ALL SELECT 'nation', true, count(*) FROM nation")
def src_fetch(spark, sf_dir):
    """Two files, fetched twice: the second time they are there."""
    folder = scratch(spark, "fetched")
    where = sf_dir if "://" in sf_dir else f"file://{sf_dir}"
    files = spark.createDataFrame([(f"{where}/{t}.parquet", f"{t}.parquet") for t in ("region", "nation")], "url string, name string")
    rows = []
    for _ in range(2):
        found = fetch.fetch(files, folder).where("error is null").collect()
        rows += [(r.name.removesuffix(".parquet"), r.skipped, spark.read.parquet(f"{folder}/{r.name}").count()) for r in found]
    return spark.createDataFrame(rows, "name string, skipped boolean, n_rows long")


@query("SELECT r_regionkey, r_name FROM region")
def src_bundle(spark, sf_dir):
    """A zip archive with a table in a folder, unpacked and read."""
    folder, raw = scratch(spark, "bundle"), io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("bundle/tables/region.csv", table(spark, sf_dir, "region").select("r_regionkey", "r_name").toPandas().to_csv(index=False))  # five rows
        z.writestr("bundle/readme.txt", "a table")
    put(spark, f"{folder}.zip", raw.getvalue())
    fetch.unpack(spark, f"{folder}.zip", folder)
    own = table(spark, sf_dir, "region").select("r_regionkey", "r_name").schema
    return spark.read.schema(own).csv(f"{folder}/bundle/tables", header=True)
