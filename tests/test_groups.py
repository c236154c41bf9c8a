"""Exact medians and samples of groups, against plain Python."""

import random
import statistics
from collections import defaultdict

from textloom.functions.numbers import hash32
from textloom.operators import mixing, quantiles
from pyspark.sql import functions as F


def test_medians_of_skewed_groups(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None, "even"]), rng.choice([rng.random() * 1e6, 7.0, None])) for _ in range(6000)] + [("one", -2.5), ("none", None), ("two", 1.0), ("two", 4.0)]
    df = spark.createDataFrame(rows, "`a.b` string, k double").repartition(5)
    want = defaultdict(list)
    for g, v in rows:
        if v is not None:
            want[g].append(v)
    got = {r["a.b"]: r.median for r in quantiles.medians(df, "k", ["a.b"]).collect()}
    assert got == {g: statistics.median(v) for g, v in want.items()}
    assert [r.median for r in quantiles.medians(df, "k", []).collect()] == [statistics.median([v for x in want.values() for v in x])]
    assert quantiles.medians(df.limit(0), "k", ["a.b"]).count() == 0


def test_median_of_many_values(spark):
    own = spark.range(300_001).select((F.col("id") * 7919 % 300_001).alias("v"))
    assert [r.median for r in quantiles.medians(own, "v", []).collect()] == [150_000.0]


def test_samples_of_groups(spark):
    rows = [("hot", k) for k in range(5000)] + [(None, k) for k in range(5000, 5100)] + [("few", k) for k in range(9000, 9003)] + [("same", 11)] * 40
    df = spark.createDataFrame(rows, "source string, id long").withColumn("level", F.lit("x")).repartition(6)
    hashes = {r.id: r.h for r in df.select("id", hash32((F.col("id") + 42).bitwiseAND(F.lit(0xFFFFFFFF))).alias("h")).collect()}
    out = mixing.sample_by(df, "source", "id", 20)
    assert out.columns == df.columns
    got, want = defaultdict(list), defaultdict(list)
    for r in out.collect():
        got[r.source].append(r.id)
    for g, k in rows:
        want[g].append(k)
    assert {g: sorted(v) for g, v in got.items()} == {g: sorted(sorted(v, key=lambda k: (hashes[k], k))[:20]) for g, v in want.items()}
    assert mixing.sample_by(df.limit(0), "source", "id", 3).count() == 0
