"""Sources: sharded Parquet with file order, JSON lines, whole-file JSON, CSV and YAML.

A Spark table has no order, so readers for which order matters add it as columns: ``shard`` (rank of the file name) and ``row`` (index in
the file). Selections that the planner can push to the files stay plain filters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions.messages import from_raw, reject_reason
from textloom.sources import schemas


def read_shards(spark: SparkSession, path: str, schema: T.StructType | None = None, skip_unreadable: bool = False) -> DataFrame:
    """Parquet files of a folder, hidden and temporary ones left out."""
    reader = spark.read.option("pathGlobFilter", "*.parquet").option("ignoreCorruptFiles", skip_unreadable)
    return (reader.schema(schema) if schema else reader).parquet(path)


def list_shards(spark: SparkSession, path: str) -> DataFrame:
    """file_name and shard (from 0) of each file. The list has a row for each file, so one task can rank it."""
    names = read_shards(spark, path).select(F.col("_metadata.file_name").alias("file_name")).distinct()
    return names.withColumn("shard", (F.row_number().over(Window.orderBy("file_name")) - 1).cast("long"))


def with_order(spark: SparkSession, path: str) -> DataFrame:
    """Rows with shard and row; the list of files is broadcast if it is small enough for the session's limit."""
    rows = read_shards(spark, path)
    rows = rows.select("*", F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.row_index").alias("row"))
    return rows.join(list_shards(spark, path), "file_name")


def strided(df: DataFrame, block: str, step: int, start: int = 0) -> DataFrame:
    """Every step-th block of rows."""
    return df.where(F.pmod(F.col(block), F.lit(step)) == start)


def of_source(df: DataFrame, source: str) -> DataFrame:
    """Equality filter, pushed to the scan."""
    return df.where(F.col("source") == source)


def of_source_prefix(df: DataFrame, prefix: str) -> DataFrame:
    """Prefix filter, pushed to the scan."""
    return df.where(F.col("source").startswith(prefix))


def after_resume(df: DataFrame, file_col: str, group_col: str, file: int, group: int, world: int, rank: int) -> DataFrame:
    """What a reader that stopped after row group ``group`` of file ``file`` still has to read: in that file the rank's groups from the
    next round on, in later files all of the rank's."""
    at = (group // world + 1) * world + rank
    own = F.pmod(F.col(group_col), F.lit(world)) == rank
    return df.where(own & ((F.col(file_col) > file) | ((F.col(file_col) == file) & (F.col(group_col) >= at))))


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType = schemas.EVAL_ITEM) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_baselines(spark: SparkSession, path: str) -> DataFrame:
    """label, baseline (percent)."""
    return spark.read.schema(schemas.BASELINE).csv(path, header=True).select(F.col("Eval Task").alias("label"), F.col("Random baseline").alias("baseline"))


def read_task_config(spark: SparkSession, text: str) -> DataFrame:
    """Tasks of a YAML configuration: label, task_type, dataset_uri, num_fewshot (the first), delimiter."""
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading YAML needs PyYAML") from e
    tasks = yaml.safe_load(text)["icl_tasks"]
    rows = [(t["label"], t["icl_task_type"], t["dataset_uri"], t["num_fewshot"][0], t.get("continuation_delimiter", " ")) for t in tasks]
    return spark.createDataFrame(rows, "label string, task_type string, dataset_uri string, num_fewshot int, delimiter string")


def raw_conversations(df: DataFrame, json_col: str = "value") -> DataFrame:
    """A row for each conversation of JSON arrays of {system?, messages: [[code, text], ...]}."""
    parsed = F.from_json(F.col(json_col), T.ArrayType(schemas.RAW_CONVERSATION))
    return df.select("*", F.posexplode(parsed).alias("item", "raw")).drop(json_col)


def ingest_custom(df: DataFrame, source: str = "custom", json_col: str = "value") -> DataFrame:
    """Conversations with reject_reason (null if valid), messages (of the valid) and source."""
    rows = raw_conversations(df, json_col).withColumn("reject_reason", reject_reason(F.col("raw")))
    return rows.withColumn("messages", F.when(F.col("reject_reason").isNull(), from_raw(F.col("raw")))).withColumn("source", F.lit(source)).drop("raw")


def union_columns(*dfs: DataFrame) -> DataFrame:
    """Union by name; a column that one lacks is null there."""
    out = dfs[0]
    for df in dfs[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def flattened(df: DataFrame) -> DataFrame:
    """If the only column is a struct, its fields."""
    if len(df.columns) == 1 and isinstance(df.schema[0].dataType, T.StructType):
        return df.select(f"{df.columns[0]}.*")
    return df


def first_rows(df: DataFrame, order: str, n: int) -> DataFrame:
    """The first n rows in order."""
    return df.orderBy(order).limit(n)


def conversations_of(df: DataFrame, source: str | None = None) -> DataFrame:
    """Conversations that hold a message, of one source if it is given."""
    own = df.where(F.size("messages") > 0)
    return own if source is None else of_source(own, source)
