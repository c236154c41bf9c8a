"""Paths for tables that a query writes and reads again."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in spark.checkpoint.dir, the folder that driver and executors share; where that is unset, in a local folder if the session is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.gettempdir()}/textloom-{os.getuid()}-{os.getpid()}"
    return f"{folder.rstrip('/')}/scratch-{name}-{uuid.uuid4().hex}"


def put(spark: SparkSession, path: str, data: str | bytes) -> None:
    """Writes a small file."""
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = own.getFileSystem(spark._jsc.hadoopConfiguration()).create(own)
    out.write(bytearray(data.encode() if isinstance(data, str) else data))
    out.close()


def remove(spark: SparkSession, path: str) -> None:
    """Removes a file or a folder, if it is there."""
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    own.getFileSystem(spark._jsc.hadoopConfiguration()).delete(own, True)
