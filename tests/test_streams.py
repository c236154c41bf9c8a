"""Next-fit in many tasks, and shards by row group."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.operators import next_fit, packing
from textloom.sources import rowgroups


def fold(n, size, used=0, gone=0):
    places = []
    for x in n:
        if used and used + x > size:
            used, gone = 0, gone + 1
        places.append((gone, used))
        used += x
        if used == size:
            used, gone = 0, gone + 1
    return places, used, gone


def test_tables_are_those_of_the_fold():
    rng = np.random.default_rng(1)
    for t in range(300):
        size = int(rng.integers(1, 12))
        n = rng.integers(0 if t % 3 else 1, size + 1, int(rng.integers(1, 15)))
        used, gone = next_fit.table_of(n, size)
        for u in range(size):
            places, end, went = fold(n.tolist(), size, u, 5)
            assert (used[u], gone[u]) == (end, went - 5)
            assert list(zip(*(x.tolist() for x in next_fit.buffers(n, size, u, 5)), strict=True)) == places


def test_streams_in_blocks_give_the_fold(spark):
    rng = random.Random(5)
    rows = [(s, i, rng.choice([1, 2, 3, 7, 16, 20])) for s, n in (("a", 700), ("b", 1), ("c", 90)) for i in range(n)]
    df = spark.createDataFrame(rows, "s string, i long, n_tokens int")
    got = {(r.s, r.i): (r.chunk, r.offset) for r in next_fit.placed(df, "n_tokens", "s", ["i"], 16, fill=2, fan=3).collect()}
    counts = {r.s: (r.chunks, r.pad, r.sequences) for r in next_fit.chunk_counts(df, "n_tokens", "s", ["i"], 16, fill=2, fan=3).collect()}
    for s in "abc":
        own = [min(n, 16) for x, _, n in rows if x == s]
        places, used, gone = fold(own, 16)
        assert [got[s, i] for i in range(len(own))] == places
        chunks = gone + (used > 0)
        assert counts[s] == (chunks, chunks * 16 - sum(own), len(own))
    empty = next_fit.placed(df.limit(0), "n_tokens", "s", ["i"], 16)
    assert empty.count() == 0


@pytest.mark.parametrize("flush", [False, True])
def test_chunks_are_those_of_one_task(spark, flush):
    rng = random.Random(7)
    rows = [("s", i, [rng.randrange(50) for _ in range(rng.choice([1, 4, 9, 30]))]) for i in range(150)]
    df = spark.createDataFrame(rows, "s string, i long, t array<int>").withColumn("m", F.transform("t", lambda x: x % 2))
    a = next_fit.aligned_chunks(df, "t", "m", "s", ["i"], 16, flush, fill=2, fan=2)
    b = packing.aligned_chunks(df, "t", "m", "s", ["i"], 16, flush)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_a_large_stream_runs_in_many_tasks(spark):
    df = spark.range(300_000).select(F.lit(0).alias("s"), F.col("id").alias("i"), (F.pmod(F.xxhash64("id"), F.lit(300)) + 1).alias("length"))
    got = next_fit.placed(df, "length", "s", ["i"], 2048, fill=64, fan=16)
    n = np.array([r.length for r in df.orderBy("i").collect()])
    want, _, _ = fold(n.tolist(), 2048)
    assert [(r.chunk, r.offset) for r in got.orderBy("i").collect()] == want


def test_lost_shards_are_written_again(spark, tmp_path):
    df = spark.range(95).select(F.col("id").alias("k"), F.concat(F.lit("t"), "id").alias("text"))
    path = f"{tmp_path}/shards"
    first = rowgroups.write_numbered(df, path, "k", rows=20, group_rows=6).orderBy("shard").collect()
    assert [(r.name, r.rows, r.written) for r in first] == [(f"shard_{i:05d}.parquet", 20 if i < 4 else 15, True) for i in range(5)]
    (tmp_path / "shards/shard_00002.parquet").unlink()
    (tmp_path / "shards/shard_00003.parquet").write_bytes(b"half a fi")
    stamp = (tmp_path / "shards/shard_00001.parquet").stat().st_mtime_ns
    again = rowgroups.write_numbered(df, path, "k", rows=20, group_rows=6).orderBy("shard").collect()
    assert [r.written for r in again] == [False, False, True, True, False]
    assert (tmp_path / "shards/shard_00001.parquet").stat().st_mtime_ns == stamp
    assert sorted(r.k for r in spark.read.parquet(path).collect()) == list(range(95))
    assert not list((tmp_path / "shards").glob("_attempt*"))


def test_groups_are_read_as_chosen(spark, tmp_path):
    df = spark.range(60).select(F.col("id").alias("k"), (F.col("id") % 3).cast("int").alias("v"))
    path = f"{tmp_path}/shards"
    rowgroups.write_numbered(df, path, "k", rows=25, group_rows=10)
    (tmp_path / "shards/shard_00009.parquet").write_bytes(b"no Parquet")
    found = rowgroups.footers(spark, path)
    assert sorted(r.name for r in rowgroups.unreadable(found).collect()) == ["shard_00009.parquet"]
    assert all(r.error for r in rowgroups.unreadable(found).collect())
    groups = sorted((r.file, r.row_group, r.rows) for r in found.where("error is null").collect())
    assert groups == [(0, 0, 10), (0, 1, 10), (0, 2, 5), (1, 0, 10), (1, 1, 10), (1, 2, 5), (2, 0, 10)]
    got = rowgroups.read_groups(rowgroups.of_stride(found, 2), df.schema).orderBy("k").collect()
    assert [r.k for r in got] == [*range(10), *range(20, 35), *range(45, 60)]
    assert all(r.v == r.k % 3 and r.row == r.k % 25 and r.file == r.k // 25 for r in got)
    assert rowgroups.read_groups(found.limit(0), df.schema).count() == 0
