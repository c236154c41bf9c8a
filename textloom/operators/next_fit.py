"""Next-fit of one large ordered stream in many tasks.

Which buffer a sequence goes to depends on all sequences before it, but only through one number: the tokens in the buffer that is open. So a block of neighbouring sequences
is a table: for each number of tokens that the open buffer may have before it, the number after it, and the buffers that went meanwhile.

1. Blocks (of about ``FILL`` buffers' tokens) make their tables, each in a task of its own. The next start from each sequence is a search in prefix sums; chains of starts are followed by pointer
   doubling, all at once.
2. Tables of neighbouring blocks are composed, ``FAN`` at a time, in rounds, until a stream is one table.
3. Down again: what is open before a table and how many buffers went before it give the same for each of its parts.
4. Each block places its sequences.

A task holds a block, or ``FAN`` tables. Sequences without tokens take part as they come, in the open buffer, or in the next if the last one has just gone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.operators.ordering import running_sum
from textloom.operators.tokens import PAD
from textloom.sources.scratch import scratch

FILL = 512
FAN = 256


def starts(n: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For sequences of n tokens (``size`` at most): tokens before each (and at the end); the sequence that begins the next buffer after one begun here, or -1 where the
    block ends before; whether the buffer goes at the block's end, being full."""
    before = np.concatenate(([0], np.cumsum(n)))
    return before, *following(before, before[:-1] + size, len(n))


def following(before: np.ndarray, goal: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Where buffers end that are full at ``goal``: the sequence that begins the next one (``rows`` if that is not of this block), and whether one goes at all."""
    at = np.searchsorted(before, goal)
    goes = at <= rows
    at = np.minimum(at, rows)
    return np.where(goes, np.where(before[at] == goal, at, at - 1), rows), goes


def table_of(n: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each number of tokens in the open buffer before the block (from 0 to size - 1): the number after it, and the buffers that went."""
    rows = len(n)
    before, to, goes = starts(n, size)
    to, gone = np.append(to, rows), np.append(goes, False).astype(np.int64)
    used = np.where(gone == 0, before[-1] - before, 0)  # at the end of the chain, where it is known
    while (to < rows).any():
        used = np.where(to < rows, used[to], used)
        gone, to = gone + gone[to], to[to]
    open_ = np.arange(size)
    at, goes = following(before, size - open_, rows)
    at[0], goes[0] = 0, False  # an empty buffer begins with the block
    end = np.where(goes | (open_ == 0), used[at], open_ + before[-1])
    return end, np.where(goes, 1 + gone[at], np.where(open_ == 0, gone[0], 0))


def buffers(n: np.ndarray, size: int, used: int, gone: int) -> tuple[np.ndarray, np.ndarray]:
    """The buffer of each sequence and its offset there, with ``used`` tokens open and ``gone`` buffers gone before the block."""
    before, to, _ = starts(n, size)
    first = [] if used else [0]
    if used:
        at, goes = following(before, np.array([size - used]), len(n))
        first = [int(at[0])] if goes[0] else [len(n)]
    while first[-1] < len(n):
        first.append(int(to[first[-1]]))
    first = np.array([x for x in first if x < len(n)], np.int64)
    turn = np.searchsorted(first, np.arange(len(n)), "right")
    base = np.concatenate(([-used], before[first]))
    return gone + turn - (0 if used else 1), before[:-1] - base[turn]


def kept(df: DataFrame, name: str) -> DataFrame:
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def blocks_of(df: DataFrame, length: str, stream: str, order: list[str], size: int, fill: int) -> DataFrame:
    """Adds n (tokens, ``size`` at most), start (tokens before) and block."""
    own = df.withColumn("n", F.least(F.col(length).cast("long"), F.lit(size)))
    own = running_sum(own, order, F.col("n"), "start", [stream])
    return own.withColumn("block", F.floor(F.col("start") / (size * fill)).cast("long"))


def tables_of(blocks: DataFrame, stream: str, order: list[str], size: int) -> DataFrame:
    """stream, block, used, gone, tokens, sequences: the table of each block."""

    def run(table: pa.Table) -> pa.Table:
        own = table.sort_by([(c, "ascending") for c in order])
        n = own["n"].to_numpy()
        used, gone = table_of(n, size)
        return pa.table([own[stream].slice(0, 1), own["block"].slice(0, 1), pa.array([used.astype(np.int32)]), pa.array([gone]), pa.array([int(n.sum())]), pa.array([len(n)])], schema=pa.schema([(stream, own[stream].type), ("block", pa.int64()), *((k, v) for k, v in TABLE)]))

    schema = T.StructType([blocks.schema[stream], *TABLE_FIELDS])
    return blocks.select(stream, *order, "n", "block").groupBy(stream, "block").applyInArrow(run, schema)


TABLE = [("used", pa.list_(pa.int32())), ("gone", pa.list_(pa.int64())), ("tokens", pa.int64()), ("sequences", pa.int64())]
TABLE_FIELDS = [T.StructField("block", T.LongType()), T.StructField("used", T.ArrayType(T.IntegerType())), T.StructField("gone", T.ArrayType(T.LongType())), T.StructField("tokens", T.LongType()), T.StructField("sequences", T.LongType())]


def listed(column: pa.ChunkedArray) -> np.ndarray:
    """A column of lists of one length, as an array of two dimensions."""
    flat = column.combine_chunks()
    return flat.flatten().to_numpy().reshape(len(flat), -1)


def composed(tables: DataFrame, stream: str, fan: int) -> DataFrame:
    """Tables of ``fan`` neighbours as one."""

    def run(table: pa.Table) -> pa.Table:
        own = table.sort_by("block")
        used, gone = listed(own["used"]), listed(own["gone"])
        at, total = np.arange(used.shape[1]), np.zeros(used.shape[1], np.int64)
        for u, g in zip(used, gone, strict=True):
            total, at = total + g[at], u[at].astype(np.int64)
        names = [stream, "block", *(k for k, _ in TABLE)]
        values = [own[stream].slice(0, 1), own["above"].slice(0, 1), pa.array([at.astype(np.int32)]), pa.array([total]), pa.array([sum(own["tokens"].to_pylist())]), pa.array([sum(own["sequences"].to_pylist())])]
        return pa.table(values, schema=pa.schema([(stream, own[stream].type), ("block", pa.int64()), *TABLE])).select(names)

    schema = T.StructType([tables.schema[stream], *TABLE_FIELDS])
    return tables.withColumn("above", F.floor(F.col("block") / fan).cast("long")).groupBy(stream, "above").applyInArrow(run, schema)


def walked(tables: DataFrame, entries: DataFrame, stream: str, fan: int) -> DataFrame:
    """stream, block, open, before: what each table begins with, from what its group of ``fan`` begins with (entries: stream, block, open, before)."""

    def run(table: pa.Table) -> pa.Table:
        own = table.sort_by("block")
        used, gone = listed(own["used"]), listed(own["gone"])
        at, before, out = own["open"][0].as_py(), own["before"][0].as_py(), []
        for u, g in zip(used, gone, strict=True):
            out.append((at, before))
            at, before = int(u[at]), before + int(g[at])
        return pa.table([own[stream], own["block"], pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.int64())], names=[stream, "block", "open", "before"])

    schema = T.StructType([tables.schema[stream], *(T.StructField(c, T.LongType()) for c in ("block", "open", "before"))])
    above = entries.withColumnRenamed("block", "above")
    return tables.withColumn("above", F.floor(F.col("block") / fan).cast("long")).join(above, [stream, "above"]).groupBy(stream, "above").applyInArrow(run, schema)


def levels_of(tables: DataFrame, stream: str, fan: int) -> list[DataFrame]:
    """Tables of blocks, of ``fan`` blocks, and so on, until each stream has one."""
    levels = [kept(tables, "tables")]
    while (levels[-1].agg(F.max("block").alias("m")).first().m or 0) > 0:
        levels.append(kept(composed(levels[-1], stream, fan), "tables"))
    return levels


def placed(df: DataFrame, length: str, stream: str, order: list[str], size: int, fill: int = FILL, fan: int = FAN) -> DataFrame:
    """``df`` with chunk and offset: where next-fit puts each sequence (cut to ``size``) of each stream, in order. ``df`` has no columns n, start, block, open, before of its own."""
    blocks = kept(blocks_of(df.select(stream, *order, length), length, stream, order, size, fill), "blocks")
    levels = levels_of(tables_of(blocks, stream, order, size), stream, fan)
    entries = levels[-1].select(stream, "block", F.lit(0).cast("long").alias("open"), F.lit(0).cast("long").alias("before"))
    for tables in reversed(levels[:-1]):
        entries = walked(tables, entries, stream, fan)

    def run(table: pa.Table) -> pa.Table:
        own = table.sort_by([(c, "ascending") for c in order])
        chunk, offset = buffers(own["n"].to_numpy(), size, own["open"][0].as_py(), own["before"][0].as_py())
        return own.select([stream, *order, "n"]).append_column("chunk", pa.array(chunk.astype(np.int64))).append_column("offset", pa.array(offset.astype(np.int64)))

    schema = T.StructType([blocks.schema[c] for c in (stream, *order)] + [T.StructField(c, T.LongType()) for c in ("n", "chunk", "offset")])
    return blocks.join(entries, [stream, "block"]).groupBy(stream, "block").applyInArrow(run, schema)


def chunk_counts(df: DataFrame, length: str, stream: str, order: list[str], size: int, fill: int = FILL, fan: int = FAN) -> DataFrame:
    """chunks, pad and sequences for each stream, the last partial chunk too, from the tables alone."""
    blocks = blocks_of(df.select(stream, *order, length), length, stream, order, size, fill)
    top = levels_of(tables_of(blocks, stream, order, size), stream, fan)[-1]
    left = F.get("used", F.lit(0))
    chunks = (F.get("gone", F.lit(0)) + F.when(left > 0, 1).otherwise(0)).cast("long")
    return top.select(stream, chunks.alias("chunks"), (chunks * size - F.col("tokens")).alias("pad"), "sequences")


def aligned_chunks(df: DataFrame, tokens: str, mask: str, stream: str, order: list[str], size: int, flush: bool = False, fill: int = FILL, fan: int = FAN) -> DataFrame:
    """The chunks of ``packing.aligned_chunks``, with streams in many tasks: stream, chunk, tokens, mask, n_seqs, n_pad."""
    own = df.select(stream, *order, F.col(tokens).cast("array<int>").alias("t"), F.col(mask).cast("array<int>").alias("m"), F.size(tokens).alias("length"))
    at = placed(own.drop("t", "m"), "length", stream, order, size, fill, fan)
    piece = F.struct("offset", *order, F.slice("t", F.lit(1), F.lit(size)).alias("t"), F.slice("m", F.lit(1), F.lit(size)).alias("m"))
    whole = own.drop("length").join(at, [stream, *order]).groupBy(stream, "chunk").agg(F.sort_array(F.collect_list(piece)).alias("pieces"), F.sum("n").alias("n"), F.count("*").alias("n_seqs"))
    filled = lambda c, fill: F.concat(F.flatten(F.col(f"pieces.{c}")), F.array_repeat(F.lit(fill), (F.lit(size) - F.col("n")).cast("int")))
    last = whole.groupBy(stream).agg(F.max("chunk").alias("last"))
    gone = whole.join(last, stream).where((F.col("chunk") < F.col("last")) | (F.col("n") == size) | F.lit(flush)).where("n > 0")
    return gone.select(stream, "chunk", filled("t", PAD).alias("tokens"), filled("m", 0).alias("mask"), "n_seqs", (F.lit(size) - F.col("n")).alias("n_pad"))
