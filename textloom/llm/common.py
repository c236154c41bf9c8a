"""What several operators share: tables in the shared folder, and runs of grouped rows as Arrow tables."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local one if the session is local (tests), else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"set spark.checkpoint.dir to a folder that the driver and all executors share (the master is {master!r})")
        found = "file://" + os.path.join(tempfile.gettempdir(), f"textloom-{os.getuid()}-{os.getpid()}")
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/textloom-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again.

    This cuts the lineage and gives every later use the same rows, also after an executor is lost.
    The columns are nullable afterwards. ``discard`` removes the files once nothing reads them.
    """
    path = shared_path(df.sparkSession, name)
    _written.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_written: list[str] = []


def release(spark: SparkSession) -> None:
    """Removes all tables that this driver has stored. For after the results are written elsewhere."""
    for path in map(spark._jvm.org.apache.hadoop.fs.Path, _written):
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    _written.clear()


def discard(df: DataFrame) -> None:
    """Removes a table that ``stored`` wrote."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(file.rpartition("/")[0])
        if path.getName().startswith("textloom-"):
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
            _written[:] = [x for x in _written if not x.endswith("/" + path.getName())]


BATCH_BYTES = 2 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Rows go to Python in batches of at most ``BATCH_BYTES``, unless the application has set a size of its own. Spark's default allows for
    ten thousand rows, however long their texts are; each task holds a batch on both sides."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not spark.sparkContext.getConf().contains(key):
        spark.conf.set(key, str(BATCH_BYTES))


def fresh(name: str, columns: list[str]) -> str:
    """The name, made longer until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def mapped(df: DataFrame, fn: Callable, schema) -> DataFrame:
    """``mapInArrow`` for columns of any name: the columns have numbers on the way, since a dot in a name would be read as a field of a struct."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return fn(b.rename_columns(names) for b in batches)

    return df.toDF(*[f"c{k}" for k in range(len(names))]).mapInArrow(run, schema)


def trim() -> None:
    """Gives memory that this worker has freed back to the machine; the next stage's work may be another worker's."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def lean(fn: Callable) -> Callable:
    """A generator function that trims the worker's memory at its end."""

    @functools.wraps(fn)
    def own(*args, **named):
        try:
            yield from fn(*args, **named)
        finally:
            trim()

    return own


def parts(rows: int, each: int, least: int = 1) -> int:
    """Partitions for so many rows with ``each`` in one."""
    return max(least, -(-rows // each))


def dealt(df: DataFrame, keys: list[str], *order: str, rows: int = 0, each: int = 200_000) -> DataFrame:
    """Dealt by the keys and sorted by them (and ``order``) within partitions, for a function whose work isn't told by the bytes it reads: there are
    as many partitions as the session has, more where ``rows`` are more than ``each`` in one."""
    n = parts(rows, each, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n, *keys).sortWithinPartitions(*keys, *order)


@lean
def runs(
    batches: Iterator[pa.RecordBatch], keys: list[str], fn: Callable[[pa.Table], Iterator[pa.RecordBatch]], most: int = 20_000, most_bytes: int = 8 << 20
) -> Iterator[pa.RecordBatch]:
    """Feeds ``fn`` with tables of whole groups, for a stream that is sorted by ``keys`` within its partition.

    A table holds several whole groups, of about ``most`` rows or ``most_bytes`` together where there are that many; what one call
    holds is bounded by that and by the largest group, so callers split groups before they grow large.
    """
    held: list[pa.RecordBatch] = []
    n = size = 0
    for whole in batches:
        for at in range(0, whole.num_rows, most):
            batch = whole.slice(at, most)
            held.append(batch)
            n, size = n + batch.num_rows, size + batch.nbytes
            if n < most and size < most_bytes:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            cut = last_group(table, keys)
            if cut:
                yield from fn(table.slice(0, cut))
                held, n, size = table.slice(cut).combine_chunks().to_batches(), table.num_rows - cut, 0
            else:
                held, n, size = table.to_batches(), 0, 0  # one group still: look again after as much more
    if held:
        yield from fn(pa.Table.from_batches(held).combine_chunks())


def gathered(batches: Iterator[pa.RecordBatch], most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Batches joined until they have ``most_bytes``, for work that repeats itself in each; none without rows."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.nbytes for x in held) >= most_bytes:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def last_group(table: pa.Table, keys: list[str]) -> int:
    """Row at which the last group begins."""
    last = table.num_rows - 1
    end = [table[k][last] for k in keys]
    lo, hi = 0, last
    while lo < hi:  # the stream is sorted, so rows equal to the last one are a suffix
        mid = (lo + hi) // 2
        if all(table[k][mid].equals(e) for k, e in zip(keys, end, strict=True)):
            hi = mid
        else:
            lo = mid + 1
    return lo


def among(df: DataFrame, ids: DataFrame, column: str | list[str], how: str = "left_semi", most: int = 500_000) -> DataFrame:
    """The rows of ``df`` whose column (or columns) are in ``ids`` (a stored table without repeats), or with ``left_anti`` the others. Up to ``most`` ids are broadcast, so
    that ``df`` stays where it is; more are joined."""
    return df.join(F.broadcast(ids) if ids.count() <= most else ids, column, how)


def first_ranked(df: DataFrame, by: list[str], order: list, item: str, top: int, rows: int, each: int = 8_000, fan: int = 16) -> DataFrame:
    """The first ``top`` rows of each group, with their rank: in parts of about ``each`` of the ``rows`` (by a hash of ``item``), whose first rows meet in rounds of ``fan`` parts, so that a
    task ranks ``fan * top`` rows of a group at most, however large it is."""
    salt = fresh("salt", df.columns)
    n = parts(rows, max(each, 2 * top))
    own = df.withColumn(salt, F.pmod(F.xxhash64(item), F.lit(n).cast("long")))
    rank = lambda *keys: F.row_number().over(Window.partitionBy(*by, *keys).orderBy(*order))
    while n > 1:
        own = own.withColumn("rank", rank(salt)).where(f"rank <= {int(top)}").withColumn(salt, F.floor(F.col(salt) / fan))
        n = -(-n // fan)
    return own.drop(salt).withColumn("rank", rank()).where(f"rank <= {int(top)}")


def bounds(*columns) -> list[int]:
    """Starts of the groups of equal neighbours in numpy arrays, and the number of rows at the end."""
    import numpy as np

    n = len(columns[0])
    if not n:
        return [0]
    new = np.zeros(n, bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return [*np.flatnonzero(new).tolist(), n]
