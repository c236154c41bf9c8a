"""Streaming packing: state for each stream (shard) is the residual of linear packing or the buffer of aligned packing.

There is no event time. Rows of a stream are taken in the order of their ``order`` column within a micro-batch, and a source with ordered files gives the batches in order. Where files may come in
any order, ``numbered=True`` says that ``order`` counts each stream's rows from 0 without gaps: rows that come early wait in the state, rows that came before are left out, so the chunks are those
of the batch operator whatever the order of arrival, and a file that is delivered twice counts once. The state is a chunk (and the row that fills it), the next number, and the rows that wait.

With a checkpoint and ``sinks.into_folders`` a query that is killed at any moment and started again writes each chunk once. Null tokens are none; streams without tokens give no chunk.

There a task holds the rows that a stream has in a micro-batch, and those that wait. Where that is too much, ``linear_sink`` gives the linear chunks of numbered rows by arithmetic on running sums:
the state is a table beside the chunks, and a task holds ``BLOCK`` rows or a chunk, however large a stream, a micro-batch or the disorder is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from textloom.operators.tokens import PAD
from textloom.sources.scratch import remove
from textloom.streaming import sinks

CHUNKS = "stream string, chunk long, tokens array<int>, n_pad long"
#: tokens of the open chunk, number of the next chunk and the next row, and the rows that wait: numbers, lengths, tokens
STATE = "buffer binary, chunk long, next long, early_rows array<bigint>, early_sizes array<int>, early binary"
_NONE = np.empty(0, np.int32)
#: Rows of ``linear_sink``'s folders: whole chunks (chunk), each stream's open chunk with the number of its last row (open), and rows that wait (early).
KINDS = "stream string, chunk long, order long, tokens array<int>, kind string"
#: Neighbouring rows of a stream that meet in a task.
BLOCK = 1024


def linear_stream(df: DataFrame, size: int, numbered: bool = False) -> DataFrame:
    """Chunks of the concatenated tokens of each stream. ``df``: stream string, order long, tokens array<int>."""

    def chunks(buffer: np.ndarray, rows: list[np.ndarray]) -> tuple[list[tuple[np.ndarray, int]], np.ndarray]:
        whole = np.concatenate([buffer, *rows])
        full = len(whole) // size * size
        return [(c, 0) for c in whole[:full].reshape(-1, size)], whole[full:]

    return _packed(df, chunks, numbered)


def aligned_stream(df: DataFrame, size: int, numbered: bool = False) -> DataFrame:
    """Next-fit chunks of whole sequences of each stream."""

    def chunks(buffer: np.ndarray, rows: list[np.ndarray]) -> tuple[list[tuple[np.ndarray, int]], np.ndarray]:
        out, held, used = [], [buffer], len(buffer)
        for tokens in (t[:size] for t in rows):
            if used and used + len(tokens) > size:
                out.append((np.concatenate([*held, np.full(size - used, PAD, np.int32)]), size - used))
                held, used = [], 0
            held.append(tokens)
            used += len(tokens)
            if used == size:
                out.append((np.concatenate(held), 0))
                held, used = [], 0
        return out, np.concatenate([_NONE, *held])

    return _packed(df, chunks, numbered)


def linear_sink(path: str, size: int) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: chunks of the concatenated tokens of each stream. A micro-batch has stream string, order long (numbers from 0 without gaps), tokens array<int>; rows come in any order,
    and one that comes again counts once. ``linear_sunk`` reads the chunks.

    A micro-batch's folder holds its chunks and what is left for the next one, so a batch that is run again finds what it found before. The open chunk's tokens are a row with the number of
    the last row taken. A row's turn has come if as many rows of its stream lie before it as its number says; counts and tokens before a row are sums of blocks and sums in its block."""
    sink = sinks.into_folders(path, ["kind"])
    folder = lambda number: f"{path.rstrip('/')}/batch={number:012d}"

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        order = F.coalesce("order", F.raise_error(F.lit("a row of the stream has no number")).cast("long"))
        none = F.lit(None).cast("long")
        rows = batch.select("stream", order.alias("order"), F.coalesce("tokens", F.array().cast("array<int>")).alias("tokens"), F.lit(True).alias("late"), none.alias("at"))
        if number:
            left = spark.read.schema(KINDS).parquet(folder(number - 1)).where("kind <> 'chunk'")
            rows = rows.unionByName(left.select("stream", "order", "tokens", F.lit(False).alias("late"), F.when(F.col("kind") == "open", F.col("chunk") * size).alias("at")))
        for kind in ("open", "early") if number > 1 else ():
            remove(spark, f"{folder(number - 2)}/kind={kind}")  # the batch that read them is committed
        sink(_cut(_placed(rows), size), number)

    return step


def linear_sunk(spark: SparkSession, path: str) -> DataFrame:
    """The chunks that ``linear_sink`` has written: stream, chunk, tokens, batch."""
    return sinks.finished(spark, path, KINDS).where("kind = 'chunk'").select("stream", "chunk", "tokens", "batch")


def _placed(rows: DataFrame) -> DataFrame:
    """Adds n, turn (whether all rows from the open chunk's on are there) and start (tokens before the row). The row of a stream's open chunk has its start as ``at``, others have null.
    Rows before that one came before; of rows with one number the first is kept."""
    block = lambda c: F.shiftright(c, BLOCK.bit_length() - 1)
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    key, stream = Window.partitionBy("key"), Window.partitionBy("key.stream")
    own = rows.withColumn("key", F.struct("stream", block("order").alias("block"))).repartition("key")  # a struct, so that null streams meet
    own = own.withColumns({"again": F.lag("order").over(key.orderBy("order", "late", "tokens")), "first": F.max(F.when(F.col("at").isNotNull(), F.col("order"))).over(key)})
    own = own.where("(again is null or again <> order) and (first is null or order >= first)").withColumn("n", F.size("tokens").cast("long"))
    sums = own.groupBy("key").agg(F.count("*").alias("rows"), F.sum("n").alias("total"), F.max("first").alias("first"), F.max("at").alias("at"))
    sums = sums.withColumns({c: F.coalesce(F.max(c).over(stream), F.lit(0)) for c in ("first", "at")}).where(F.col("key.block") >= block("first"))
    offsets = sums.select("key", "first", *[before(c, stream.orderBy("key.block")).alias(c) for c in ("rows", "total")], "at")
    own = own.drop("first", "at").withColumns({"ahead": before(F.lit(1), key.orderBy("order")), "start": before("n", key.orderBy("order"))}).join(offsets, "key")
    turn = F.col("first") + F.col("rows") + F.col("ahead") == F.col("order")
    return own.select("stream", "order", "tokens", "n", turn.alias("turn"), (F.col("at") + F.col("total") + F.col("start")).alias("start"))


def _cut(placed: DataFrame, size: int) -> DataFrame:
    """Placed rows as rows of ``KINDS``. A row goes to the chunks it touches and to that in which it ends, even with none of its tokens, so that each stream has an open chunk."""
    touched = F.when(F.col("turn"), F.sequence(F.floor(F.col("start") / size), F.floor((F.col("start") + F.col("n")) / size))).otherwise(F.array(F.lit(None).cast("long")))
    lo = F.greatest(F.col("chunk") * size - F.col("start"), F.lit(0)).cast("int")
    hi = F.least((F.col("chunk") + 1) * size - F.col("start"), "n").cast("int")
    pieces = placed.withColumn("chunk", F.explode(touched)).withColumn("piece", F.when(F.col("turn"), F.slice("tokens", lo + 1, hi - lo)).otherwise(F.col("tokens")))
    each = F.collect_list(F.when(F.size("piece") > 0, F.struct("order", "piece")))
    chunks = pieces.groupBy("stream", "chunk", F.when(~F.col("turn"), F.col("order")).alias("early")).agg(each.alias("pieces"), F.max("order").alias("order"), F.sum(F.size("piece")).alias("held"))
    tokens = F.flatten(F.transform(F.sort_array("pieces"), lambda p: p["piece"]))
    kind = F.when(F.col("early").isNotNull(), "early").when(F.col("held") == size, "chunk").otherwise("open")
    return chunks.select("stream", "chunk", "order", tokens.alias("tokens"), kind.alias("kind"))


def _packed(df: DataFrame, chunks, numbered: bool) -> DataFrame:
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        buffer, chunk, number, *waiting = state.get if state.exists else (b"", 0, 0, [], [], b"")
        rows = sorted([*_rows(*waiting), *_arrived(frames)], key=lambda r: r[0])
        early = []
        if numbered:
            rows, early, number = _in_turn(rows, number)
        out, rest = chunks(np.frombuffer(buffer, np.int32), [t for _, t in rows])
        kept = np.concatenate([_NONE, *[t for _, t in early]]).tobytes()
        state.update((rest.astype(np.int32).tobytes(), chunk + len(out), number, [n for n, _ in early], [len(t) for _, t in early], kept))
        yield pd.DataFrame([(key[0], chunk + i, tokens, pad) for i, (tokens, pad) in enumerate(out)], columns=["stream", "chunk", "tokens", "n_pad"])

    return df.groupBy("stream").applyInPandasWithState(step, CHUNKS, STATE, "append", GroupStateTimeout.NoTimeout)


def _arrived(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[int, np.ndarray]]:
    for f in frames:
        for n, tokens in zip(f["order"], f["tokens"], strict=True):
            yield int(n), _NONE if tokens is None else np.asarray(tokens, np.int32)


def _rows(numbers: list[int], sizes: list[int], tokens: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """The rows that wait in the state."""
    ends = np.cumsum(np.asarray(sizes, np.int64))
    for n, size, end in zip(numbers, sizes, ends, strict=True):
        yield int(n), np.frombuffer(tokens, np.int32)[end - size : end]


def _in_turn(rows: list[tuple[int, np.ndarray]], number: int) -> tuple[list, list, int]:
    """Of sorted rows those whose turn it is, those that come early, and the number that is next; a number counts once."""
    now, early = [], []
    for row in rows:
        if row[0] == number:
            now.append(row)
            number += 1
        elif row[0] > number and not (early and early[-1][0] == row[0]):
            early.append(row)
    return now, early, number
