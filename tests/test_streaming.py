import random

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from textloom.operators import packing
from textloom.operators.tokens import PAD
from textloom.streaming import mixing as smixing
from textloom.streaming import packing as spacking
from textloom.streaming import sinks


def test_streams_give_the_chunks_of_the_batch(spark, tmp_path):
    rng = random.Random(1)
    rows = [("s%d" % (i % 3), i, [rng.randrange(100) for _ in range(rng.choice([1, 5, 9, 30]))]) for i in range(60)]
    schema = "stream string, order long, tokens array<int>"
    for k in range(3):  # three files, in order
        spark.createDataFrame(rows[20 * k : 20 * k + 20], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    for name, fn in (("linear", spacking.linear_stream), ("aligned", spacking.aligned_stream)):
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        q = fn(source, 12).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/{name}").start()
        q.processAllAvailable()
        q.stop()
        got = sorted((r.stream, r.chunk, list(r.tokens)) for r in spark.table(name).collect())
        whole = spark.createDataFrame(rows, schema)
        if name == "linear":
            want = packing.linear_chunks(whole, "tokens", ["order"], 12, ["stream"])
        else:
            want = packing.aligned_chunks(whole.withColumn("m", F.transform("tokens", lambda t: F.lit(1))), "tokens", "m", "stream", ["order"], 12)
        assert got == sorted((r.stream, r.chunk, list(r.tokens)) for r in want.collect())
        assert name == "linear" or any(PAD in t for *_, t in got)


def test_mixing_stream(spark, tmp_path):
    weights = {"a": 0.75, "b": 0.25}
    rows = spark.createDataFrame([("a", k, f"a{k}") for k in range(5)] + [("b", k, f"b{k}") for k in range(3)], "source string, row long, text string")
    out = []
    q = smixing.draw_stream(spark, weights, 3, 400).writeStream.foreachBatch(smixing.into(lambda df, _: out.extend(df.collect()), rows)).option("checkpointLocation", f"{tmp_path}/mix").start()
    import time

    for _ in range(60):
        if len(out) >= 400:
            break
        time.sleep(0.5)
    q.stop()
    first = [r for r in out if r.draw < 400]
    assert len(first) == 400 and {r.text[0] == r.source for r in first} == {True}
    assert 0.65 < sum(r.source == "a" for r in first) / 400 < 0.85


@pytest.mark.parametrize("name", ["linear", "aligned"])
def test_a_killed_stream_writes_each_chunk_once(spark, tmp_path, name):
    """Files in no order, one of them twice; the query dies after a batch is written and before it is committed, twice, and goes on from its checkpoint."""
    rng = random.Random(8)
    rows = [("ab"[i % 2], i // 2, [rng.randrange(100) for _ in range(rng.choice([0, 1, 5, 9, 30]))]) for i in range(80)] + [("c", 0, None), ("c", 1, [7] * 40)]
    schema = "stream string, order long, tokens array<int>"
    parts = [rows[k : k + 14] for k in range(0, len(rows), 14)]
    rng.shuffle(parts)
    for k, part in enumerate([*parts, parts[2]]):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    fn = {"linear": spacking.linear_stream, "aligned": spacking.aligned_stream}[name]
    sink = sinks.into_folders(f"{tmp_path}/out")
    died = []

    def dying(batch, number):
        sink(batch, number)
        if number in (1, 4) and number not in died:
            died.append(number)
            raise RuntimeError("killed")

    for _ in range(3):
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        q = fn(source, 12, numbered=True).writeStream.foreachBatch(dying).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        try:
            q.awaitTermination()
        except StreamingQueryException:
            pass
    assert died == [1, 4]
    got = sorted((r.stream, r.chunk, list(r.tokens)) for r in sinks.finished(spark, f"{tmp_path}/out").collect())
    whole = spark.createDataFrame(rows, schema)
    if name == "linear":
        want = packing.linear_chunks(whole, "tokens", ["order"], 12, ["stream"])
    else:
        want = packing.aligned_chunks(whole.where("size(tokens) > 0").withColumn("m", F.transform("tokens", lambda t: F.lit(1))), "tokens", "m", "stream", ["order"], 12)
    assert got == sorted((r.stream, r.chunk, list(r.tokens)) for r in want.collect())


def test_a_sink_of_numbered_rows_writes_each_chunk_once(spark, tmp_path):
    """Files in no order, one of them twice, a file with a number twice, streams without a first row, without tokens or without a name; the query dies before and after a batch is written."""
    rng = random.Random(9)
    rows = [("ab"[i % 2], i // 2, [rng.randrange(100) for _ in range(rng.choice([0, 1, 5, 9, 12, 30]))]) for i in range(80)] + [(None, i, [i] * 7) for i in range(9)] + [("c", 0, None), ("c", 1, [7] * 24), ("d", 0, [])]
    late = [("e", 1, [1] * 30), ("e", 2, [2] * 30)]  # number 0 never comes
    schema = "stream string, order long, tokens array<int>"
    parts = [rows[k : k + 14] for k in range(0, len(rows), 14)]
    rng.shuffle(parts)
    parts[1] = parts[1] + parts[1][:3] + late
    for k, part in enumerate([*parts, parts[2]]):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    sink = spacking.linear_sink(f"{tmp_path}/out", 12)
    died = []

    def dying(batch, number):
        if number == 3 and number not in died:
            died.append(number)
            raise RuntimeError("killed")
        sink(batch, number)
        if number in (1, 4) and number not in died:
            died.append(number)
            raise RuntimeError("killed")

    for _ in range(4):
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        q = source.writeStream.foreachBatch(dying).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        try:
            q.awaitTermination()
        except StreamingQueryException as e:
            assert "killed" in str(e)
    assert died == [1, 3, 4]
    order = lambda x: (x[0] or "", *x[1:])
    got = sorted(((r.stream, r.chunk, list(r.tokens)) for r in spacking.linear_sunk(spark, f"{tmp_path}/out").collect()), key=order)
    want = packing.linear_chunks(spark.createDataFrame(rows, schema), "tokens", ["order"], 12, ["stream"])
    assert got == sorted(((r.stream, r.chunk, list(r.tokens)) for r in want.collect()), key=order)
    assert any(s is None for s, *_ in got) and sum(s == "c" for s, *_ in got) == 2


def test_one_large_stream_is_dealt_to_many_tasks(spark, tmp_path):
    """The second half comes first and waits, then all of it is placed: no task has more than a few blocks of the rows."""
    n, seen = 16 * spacking.BLOCK, []
    rows = spark.range(n).select(F.lit("s").alias("stream"), F.col("id").alias("order"), F.array_repeat(F.col("id").cast("int"), 3).alias("tokens"))
    sink = spacking.linear_sink(f"{tmp_path}/out", 64)
    placed = spacking._placed

    def looked(rows):
        out = placed(rows)
        seen.append([r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()])
        return out

    spacking._placed = looked
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small partitions stay
    try:
        sink(rows.where(F.col("order") >= n // 2), 0)
        sink(rows.where(F.col("order") < n // 2), 1)
    finally:
        spacking._placed = placed
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [sum(x) for x in seen] == [n // 2, n] and all(len(x) > 3 and max(x) <= sum(x) // 2 for x in seen)
    sink(rows.where(F.col("order") < n // 2), 2)  # whole blocks come again
    got = spacking.linear_sunk(spark, f"{tmp_path}/out")
    assert got.count() == n * 3 // 64
    assert got.where(F.exists(F.transform("tokens", lambda t, i: t != F.floor((F.col("chunk") * 64 + i) / 3)), lambda x: x)).count() == 0


def test_the_restarted_query_has_no_state_of_whole_groups(spark):
    """Its tokens lay in the state of a stream's task, so that a large stream took all of an executor's memory."""
    from pathlib import Path

    from textloom import plans

    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(shared.glob("scratch-stream-*"))
    assert plans.QUERIES["stream_restarted"](spark, "/root/testdata/sf0.001").count() > 0
    (path,) = set(shared.glob("scratch-stream-*")) - before
    assert (path / "check/offsets").exists() and not (path / "check/state").exists()


def test_empty_batches_are_no_error(spark, tmp_path):
    rows = spark.createDataFrame([("s", 0, [1, 2, 3])], "stream string, order long, tokens array<int>")
    sink = spacking.linear_sink(f"{tmp_path}/out", 2)
    for number, batch in enumerate([rows.limit(0), rows, rows.limit(0), rows]):
        sink(batch, number)
        assert spacking.linear_sunk(spark, f"{tmp_path}/out").count() == (number > 0)
