"""Queries on one large ordered stream, and on shards by row group."""

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from textloom.operators import next_fit
from textloom.operators.ordering import row_numbers
from textloom.plans.conversations import ALIGNED, LENGTHS, WORD_COUNT, lengths, word_rows
from textloom.plans.registry import query, table
from textloom.sources import readers, rowgroups
from textloom.sources.scratch import put, scratch
from textloom.streaming import packing as packed

#: All documents as one stream.
ONE = ALIGNED.replace("doc_id // 500", "0").format(size=2048, length=WORD_COUNT)


@query(ONE + "SELECT doc_id, chunk, CAST(sum(n) OVER (PARTITION BY chunk ORDER BY k) - n AS BIGINT) AS \"offset\" FROM f JOIN (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS k FROM documents) USING (k)")
def next_fit_places(spark, sf_dir):
    """The chunk and the offset of each document of one stream, in blocks of 16 chunks' tokens."""
    own = table(spark, sf_dir, "documents").select(F.pmod("doc_id", F.lit(1)).alias("stream"), "doc_id", F.size(F.split("text", " ")).alias("length"))
    return next_fit.placed(own, "length", "stream", ["doc_id"], 2048, fill=16, fan=4).select("doc_id", "chunk", "offset")


@query(
    ONE
    + ", g AS (SELECT chunk, count(*) AS n_seqs, CAST(sum(n) AS BIGINT) AS n FROM f GROUP BY chunk) SELECT chunk, n_seqs, 2048 - n AS n_pad, n AS n_tokens FROM g WHERE chunk < (SELECT max(chunk) FROM g) OR n = 2048"
)
def pack_aligned_stream(spark, sf_dir):
    own = word_rows(spark, sf_dir).withColumn("stream", F.pmod("doc_id", F.lit(1)))
    out = next_fit.aligned_chunks(own, "t", "m", "stream", ["doc_id"], 2048)
    return out.select("chunk", "n_seqs", "n_pad", F.size(F.filter("tokens", lambda x: x >= 0)).cast("long").alias("all"), F.col("n_pad").alias("p")).select("chunk", "n_seqs", "n_pad", (F.col("all") - F.col("p")).alias("n_tokens"))


@query(
    ALIGNED.replace("doc_id // 500", "source").format(size=2048, length=WORD_COUNT)
    + ", g AS (SELECT stream, chunk, count(*) AS c, CAST(sum(n) AS BIGINT) AS n FROM f GROUP BY 1, 2) SELECT stream, count(*) AS chunks, CAST(sum(2048 - n) AS BIGINT) AS pad, CAST(sum(c) AS BIGINT) AS sequences FROM g GROUP BY stream"
)
def sim_pack_stream(spark, sf_dir):
    """The length-only estimate of each source, from tables of its blocks."""
    own = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("stream"), F.size(F.split("text", " ")).alias("n_words"))
    return next_fit.chunk_counts(own, "n_words", "stream", ["doc_id"], 2048, fill=8, fan=4)


@query(
    f"""WITH d AS (SELECT doc_id, source, {LENGTHS} AS t FROM documents), f AS (SELECT doc_id, source, i, t[i + 1] AS t FROM (SELECT doc_id, source, t, unnest(range(0, len(t))) AS i FROM d)),
  g AS (SELECT source AS stream, t, row_number() OVER (PARTITION BY source ORDER BY doc_id, i) - 1 AS r FROM f)
  SELECT stream, r // 2048 AS chunk, CAST(sum(t * (r % 2048 + 1)) AS BIGINT) AS weighted FROM g GROUP BY 1, 2 HAVING count(*) = 2048"""
)
def stream_restarted(spark, sf_dir):
    """Documents' tokens arrive in eight batches of files; the query dies after its third batch is written, before it is committed, and is started again."""
    path = scratch(spark, "stream")
    files = -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // 8)  # of a batch
    own = row_numbers(table(spark, sf_dir, "documents").select("doc_id", "source", lengths().alias("tokens")), ["doc_id"], "order", ["source"])
    own.select(F.col("source").alias("stream"), "order", "tokens").repartitionByRange(8 * files, "order").write.parquet(f"{path}/in")
    sink = packed.linear_sink(f"{path}/out", 2048)

    def dying(batch, number):
        sink(batch, number)
        if number == 2:
            raise InterruptedError("the query is killed")

    for step in (dying, sink):
        source = spark.readStream.schema("stream string, order long, tokens array<int>").option("maxFilesPerTrigger", files).parquet(f"{path}/in")
        run = source.writeStream.foreachBatch(step).option("checkpointLocation", f"{path}/check").trigger(availableNow=True).start()
        try:
            run.awaitTermination()
        except StreamingQueryException as e:
            if "the query is killed" not in str(e):
                raise
    each = F.transform("tokens", lambda t, i: t.cast("long") * (i + 1))
    return packed.linear_sunk(spark, f"{path}/out").select("stream", "chunk", F.aggregate(each, F.lit(0).cast("long"), lambda a, x: a + x).alias("weighted"))


GROUPS = "WITH g AS (SELECT doc_id, source, n // 200 AS file, n % 200 // 50 AS row_group, n % 200 AS row FROM (SELECT doc_id, source, row_number() OVER (ORDER BY doc_id) - 1 AS n FROM documents)) "


def shards(spark, sf_dir, name):
    """Documents in shards of 200 rows, 50 to a row group: their path and schema."""
    path, own = scratch(spark, name), table(spark, sf_dir, "documents").select("doc_id", "source")
    rowgroups.write_numbered(own, path, "doc_id", rows=200, group_rows=50)
    return path, own.schema


@query(GROUPS + "SELECT doc_id, source, file, row_group, row FROM g WHERE row_group % 3 = 1")
def scan_row_groups(spark, sf_dir):
    """Every third row group of each shard, from the second on."""
    path, schema = shards(spark, sf_dir, "groups")
    return rowgroups.read_groups(rowgroups.of_stride(rowgroups.footers(spark, path), 3, 1), schema)


@query(GROUPS + "SELECT doc_id, file, row_group FROM g WHERE row_group % 2 = 1 AND (file > 1 OR file = 1 AND row_group >= 3)")
def scan_resumed_groups(spark, sf_dir):
    """What the second of two readers has left after row group 1 of shard 1."""
    path, schema = shards(spark, sf_dir, "resumed")
    left = readers.after_resume(rowgroups.footers(spark, path), "file", "row_group", 1, 1, 2, 1)
    return rowgroups.read_groups(left, schema).select("doc_id", "file", "row_group")


@query(GROUPS + "SELECT printf('shard_%05d.parquet', file) AS name, true AS readable, count(*) AS n_rows FROM g GROUP BY file UNION ALL SELECT 'shard_99999.parquet', false, 0")
def src_unreadable(spark, sf_dir):
    """Shards of which one can't be read: it is reported, and the others have all their rows."""
    path, _ = shards(spark, sf_dir, "broken")
    put(spark, f"{path}/shard_99999.parquet", "not a Parquet file")
    found = rowgroups.footers(spark, path)
    return found.groupBy("name").agg(F.bool_and(F.col("error").isNull()).alias("readable"), F.coalesce(F.sum("rows"), F.lit(0)).alias("n_rows"))


@query(GROUPS + "SELECT file AS shard, printf('shard_%05d.parquet', file) AS name, count(*) AS rows, file = 1 AS written FROM g GROUP BY file")
def sink_numbered(spark, sf_dir):
    """Shards of which one was lost: a second run writes that one."""
    path, own = scratch(spark, "numbered"), table(spark, sf_dir, "documents").select("doc_id", "source")
    rowgroups.write_numbered(own, path, "doc_id", rows=200, group_rows=50)
    lost = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/shard_00001.parquet")
    lost.getFileSystem(spark._jsc.hadoopConfiguration()).delete(lost, False)
    return rowgroups.write_numbered(own, path, "doc_id", rows=200, group_rows=50)
