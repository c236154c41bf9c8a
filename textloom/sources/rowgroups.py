"""Parquet shards by row group: numbered files with groups of a given size, a table of footers, and reading of chosen groups.

A footer table has a row for each row group (and one for a file that can't be read, with the reason), made by tasks. Which groups a reader takes is a filter on that table, so what is
left out is never opened: strides over groups, a resume at (file, group), or the shards of a rank. Reading sends a row for each group to the tasks.

Files are opened through pyarrow's file systems (local, HDFS, S3, GCS). Columns file, row_group and row are added; the caller's own must have other names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from textloom.operators.ordering import row_numbers

FOOTER = "path string, name string, row_group long, rows long, bytes long, error string"
GROUP_ROWS = 10_000


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    scheme, _, rest = path.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1)) if "://" in path else (fs.LocalFileSystem(), path)


def footers(spark: SparkSession, path: str) -> DataFrame:
    """file (from 0, by name), path, name, row_group, rows, bytes, error. A file that can't be read has one row, with its error and no group.
    Files without a byte are left out, as Spark's readers leave them out."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in b["path"].to_pylist():
                rows, name = [], p.rpartition("/")[2]
                try:
                    own, at = located(p)
                    with own.open_input_file(at) as f:
                        meta = pq.ParquetFile(f).metadata
                        for g in range(meta.num_row_groups):
                            group = meta.row_group(g)
                            rows.append((p, name, g, group.num_rows, group.total_byte_size, None))
                except (OSError, pa.ArrowException) as e:
                    rows = [(p, name, None, None, None, f"{type(e).__name__}: {e}"[:300])]
                yield pa.RecordBatch.from_pylist([dict(zip(FOOTER_NAMES, r, strict=True)) for r in rows], schema=FOOTER_TYPES)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select("path")
    found = files.mapInArrow(probe, FOOTER)
    order = files.select("path", (F.row_number().over(Window.orderBy("path")) - 1).cast("long").alias("file"))  # a row for each file
    return found.join(order, "path").select("file", *FOOTER_NAMES)


FOOTER_NAMES = ["path", "name", "row_group", "rows", "bytes", "error"]
FOOTER_TYPES = pa.schema([("path", pa.string()), ("name", pa.string()), ("row_group", pa.int64()), ("rows", pa.int64()), ("bytes", pa.int64()), ("error", pa.string())])


def unreadable(found: DataFrame) -> DataFrame:
    """Files that can't be read, and why."""
    return found.where("error is not null").select("file", "path", "name", "error")


def of_stride(found: DataFrame, step: int, start: int = 0) -> DataFrame:
    """Every ``step``-th row group of each file from ``start`` on."""
    return found.where(F.pmod("row_group", F.lit(step)) == start)


def read_groups(found: DataFrame, schema: T.StructType, batch_rows: int = GROUP_ROWS) -> DataFrame:
    """The rows of the row groups in a footer table (or what filters left of it): the columns of ``schema``, file, row_group and row (from 0 in the file)."""
    names = schema.names
    whole = to_arrow_schema(T.StructType([*schema, *(T.StructField(c, T.LongType()) for c in ("file", "row_group", "row"))]))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                own, at = located(r["path"])
                with own.open_input_file(at) as f:
                    file = pq.ParquetFile(f)
                    row = sum(file.metadata.row_group(g).num_rows for g in range(r["row_group"]))
                    for part in file.iter_batches(batch_rows, row_groups=[r["row_group"]], columns=names):
                        n = part.num_rows
                        numbers = [pa.array([r["file"]] * n, pa.int64()), pa.array([r["row_group"]] * n, pa.int64()), pa.array(range(row, row + n), pa.int64())]
                        yield pa.RecordBatch.from_arrays([*[part[c].cast(whole.field(c).type) for c in names], *numbers], schema=whole)
                        row += n

    own = found.where("error is null and rows > 0").select("file", "path", "row_group")
    tasks = 4 * int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = T.StructType([*schema, *(T.StructField(c, T.LongType()) for c in ("file", "row_group", "row"))])
    return own.repartition(tasks, "path", "row_group").mapInArrow(read, out)


def write_numbered(df: DataFrame, path: str, *order: str, rows: int, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Shards ``shard_00000.parquet`` and so on, of ``rows`` rows in order (the last may have fewer), in row groups of ``group_rows``; returns the manifest: shard, name, rows, written.

    A shard is written under a name of its attempt and moved to its own name when whole. A shard that is there with all its rows is left as it is (``written`` is false), so a run after
    a crash writes what is missing. The manifest is written last, to ``_manifest``, and replaces the one before."""
    names = df.columns
    own = row_numbers(df, list(order), "n_")
    own = own.withColumn("shard_", F.floor(F.col("n_") / rows).cast("long"))
    schema = to_arrow_schema(df.schema)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, n = None, [], 0
        for b in batches:
            for a, z, shard in runs_of(b["shard_"].to_pylist()):
                if shard != at and held:
                    yield done(at, held)
                    held = []
                at = shard
                held.append(b.slice(a, z - a).select(names))
        if held:
            yield done(at, held)

    def done(shard: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).cast(schema)
        name = f"shard_{shard:05d}.parquet"
        own, folder = located(path)
        target, temporary = f"{folder}/{name}", f"{folder}/_attempt-{uuid.uuid4().hex}-{name}"
        there = own.get_file_info(target).type == fs.FileType.File
        if there:
            try:
                with own.open_input_file(target) as f:
                    there = pq.ParquetFile(f).metadata.num_rows == table.num_rows
            except (OSError, pa.ArrowException):
                there = False
        if not there:
            own.create_dir(folder, recursive=True)
            with own.open_output_stream(temporary) as f:
                pq.write_table(table, f, row_group_size=group_rows)
            own.move(temporary, target)
        return pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([name]), pa.array([table.num_rows]), pa.array([not there])], ["shard", "name", "rows", "written"])

    tasks = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    made = own.repartition(tasks, "shard_").sortWithinPartitions("shard_", "n_").mapInArrow(write, "shard long, name string, rows long, written boolean")
    made.write.mode("overwrite").parquet(f"{path}/_manifest")
    return df.sparkSession.read.parquet(f"{path}/_manifest")


def runs_of(values: list) -> Iterator[tuple[int, int, object]]:
    """Runs of equal neighbours: first place, place after the last, value."""
    at = 0
    for i in range(1, len(values) + 1):
        if i == len(values) or values[i] != values[at]:
            yield at, i, values[at]
            at = i
