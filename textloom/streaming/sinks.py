"""A sink for ``foreachBatch`` that is safe to repeat."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def into_folders(path: str, by: list[str] | None = None) -> Callable[[DataFrame, int], None]:
    """Writes each micro-batch to a folder of its own number, with ``by`` to folders in it for the values of these columns. A batch that is run again, because its query ended between the writing and the commit, replaces its folder, so its rows count once."""

    def step(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(*by or []).parquet(f"{path.rstrip('/')}/batch={number:012d}")

    return step


def finished(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The rows of the batches that are whole, and ``batch``. Folders without the mark of a finished job are left out; a path without any is an error."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/batch=*/_SUCCESS")
    marks = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at) or []
    folders = [m.getPath().getParent().toString() for m in marks]  # a name for each micro-batch
    if not folders:
        raise FileNotFoundError(f"no finished batch in {path}")
    reader = spark.read.schema(f"{schema}, batch long") if schema else spark.read
    return reader.option("basePath", path).parquet(*folders).withColumn("batch", F.col("batch").cast("long"))
