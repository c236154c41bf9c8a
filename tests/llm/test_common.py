import os

import pytest

from textloom.llm import common


def test_stored_tables_go(spark):
    table = common.stored(spark.range(5), "x")
    folder = os.path.dirname(table.inputFiles()[0].removeprefix("file://"))
    assert table.count() == 5 and os.path.isdir(folder)
    common.discard(table)
    assert not os.path.exists(folder)
    other = common.stored(spark.range(5), "y")
    folder = os.path.dirname(other.inputFiles()[0].removeprefix("file://"))
    common.release(spark)
    assert not os.path.exists(folder)


def test_discard_leaves_other_tables(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/own")
    common.discard(spark.read.parquet(f"{tmp_path}/own"))
    assert spark.read.parquet(f"{tmp_path}/own").count() == 3


def test_folder_of_the_session_or_one_of_our_own():
    class Conf(dict):
        pass

    class Session:
        def __init__(self, **conf):
            self.conf = Conf({k.replace("_", "."): v for k, v in conf.items()})

    assert common.shared_dir(Session(spark_checkpoint_dir="hdfs://n/x/")) == "hdfs://n/x"
    assert common.shared_dir(Session(spark_master="local[2]")).startswith("file:///")
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):  # their machines don't share a local folder
        with pytest.raises(ValueError):
            common.shared_dir(Session(spark_master=master))


def test_first_rows_of_large_groups(spark):
    from pyspark.sql import functions as F

    from textloom.llm.common import first_ranked

    df = spark.range(5000).select((F.col("id") % 3 == 0).cast("int").alias("g"), F.pmod(F.xxhash64("id"), F.lit(700)).alias("v"), F.col("id").cast("string").alias("item"), F.lit(1).alias("salt"))
    for top, each in ((5, 10), (5, 10_000), (40, 80)):
        got = first_ranked(df, ["g"], [F.desc("v"), F.asc("item")], "item", top, 5000, each, fan=3)
        assert got.columns == [*df.columns, "rank"]
        rows = df.collect()
        for g in (0, 1):
            want = [r.item for r in sorted((r for r in rows if r.g == g), key=lambda r: (-r.v, r.item))[:top]]
            assert [r.item for r in got.where(F.col("g") == g).orderBy("rank").collect()] == want
