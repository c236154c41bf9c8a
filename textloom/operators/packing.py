"""Training chunks from token sequences: linear packing (set-based) and boundary-aligned packing (ordered).

Linear packing is arithmetic on running sums, with no order of execution. Aligned packing is next-fit, so each stream (shard) is one
ordered fold: rows are dealt by stream and sorted, a task folds lengths and copies tokens in blocks, and holds the rows of one open chunk and a batch. Streams are
shards, so their number grows with the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.operators.ordering import running_sum
from textloom.operators.tokens import PAD


def linear_chunks(df: DataFrame, tokens: str | list[str], order: list[str], size: int, by: list[str] | None = None) -> DataFrame:
    """Chunks of ``size`` tokens of the concatenation in order: by, chunk (from 0), tokens. A partial last chunk is left out.

    ``tokens`` is an array of anything, or several arrays of the same length (ids and masks), which keep their names. Each row goes to the chunks it touches, so
    nothing larger than a row or a chunk is held."""
    by, names = by or [], [tokens] if isinstance(tokens, str) else tokens
    own = df.select(*by, *order, *names, F.size(names[0]).alias("__n")).where("__n > 0")
    own = running_sum(own, order, F.col("__n"), "__start", by)
    pieces = own.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("__start") / size), F.floor((F.col("__start") + F.col("__n") - 1) / size))))
    lo = F.greatest(F.col("chunk") * size - F.col("__start"), F.lit(0)).cast("int")
    hi = F.least((F.col("chunk") + 1) * size - F.col("__start"), F.col("__n")).cast("int")
    cut = pieces.select(*by, "chunk", (hi - lo).alias("__n"), F.struct((F.col("__start") + lo).alias("at"), *[F.slice(c, lo + 1, hi - lo).alias(f"c{i}") for i, c in enumerate(names)]).alias("piece"))
    chunks = cut.groupBy(*by, "chunk").agg(F.sort_array(F.collect_list("piece")).alias("__pieces"), F.sum("__n").alias("__n")).where(F.col("__n") == size)
    own = lambda c: F.transform("__pieces", lambda p: p[c])
    return chunks.select(*by, "chunk", *[F.flatten(own(f"c{i}")).alias("tokens" if isinstance(tokens, str) else c) for i, c in enumerate(names)])


def shifted(tokens: Column, mask: Column | None = None) -> list[Column]:
    """input_ids, labels and loss_mask (ones unless given) of chunks of T + 1 tokens."""
    n = F.size(tokens) - 1
    own = F.transform(F.slice(tokens, F.lit(2), n), lambda _: F.lit(1)) if mask is None else F.slice(mask, F.lit(2), n)
    return [F.slice(tokens, F.lit(1), n).alias("input_ids"), F.slice(tokens, F.lit(2), n).alias("labels"), own.cast("array<float>").alias("loss_mask")]


def with_bos(tokens: Column, bos: int) -> Column:
    """A chunk that begins with ``bos`` in place of its last token."""
    return F.concat(F.array(F.lit(bos)), F.slice(tokens, F.lit(1), F.size(tokens) - 1))


def aligned_chunks(df: DataFrame, tokens: str, mask: str, stream: str, order: list[str], size: int, flush: bool = False) -> DataFrame:
    """Next-fit chunks of whole sequences in order, for each stream: stream, chunk, tokens, mask, n_seqs, n_pad.

    A sequence is cut to ``size``. What doesn't fit sends the buffer on, padded; a full buffer goes at once. The last partial buffer
    is left out unless ``flush``. ``tokens`` and ``mask`` are arrays of whole numbers of the same length.
    """
    schema = T.StructType([df.schema[stream], *(T.StructField(c, t) for c, t in (("chunk", T.LongType()), ("tokens", T.ArrayType(T.IntegerType())), ("mask", T.ArrayType(T.IntegerType())), ("n_seqs", T.LongType()), ("n_pad", T.LongType())))])
    own = df.select(stream, *order, F.col(tokens).cast("array<int>").alias("__t"), F.col(mask).cast("array<int>").alias("__m"))
    dealt = own.repartition(stream).sortWithinPartitions(stream, *order)
    return dealt.mapInArrow(lambda batches: next_fit(batches, stream, size, flush), schema)


def fit(n: np.ndarray, size: int, used: int = 0) -> tuple[list[tuple[int, int]], int]:
    """Next-fit of sequences of n tokens (``size`` at most) into buffers, of which the open one has ``used`` tokens: for each buffer that goes, the sequences taken
    by then and its tokens; and the tokens of the open one."""
    total, at, out = np.cumsum(n), 0, []
    while at < len(n):
        done = int(total[at - 1]) if at else 0
        goal = done + size - used
        to = int(np.searchsorted(total, goal))
        if to == len(n):
            return out, used + int(total[-1]) - done
        full = total[to] == goal
        out.append((to + 1, size) if full else (to, used + (int(total[to - 1]) - done if to > at else 0)))
        at, used = out[-1][0], 0
    return out, used


def stream_runs(b: pa.RecordBatch, stream: str) -> Iterator[tuple[object, int, int]]:
    """Runs of rows of one stream: its value, first row, row after the last."""
    codes = b[stream].dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    cuts = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), len(codes)]
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        yield b[stream][lo].as_py(), lo, hi


def next_fit(batches: Iterator[pa.RecordBatch], stream: str, size: int, flush: bool) -> Iterator[pa.RecordBatch]:
    key, chunk, kind = None, 0, None
    held: list[pa.RecordBatch] = []  # rows of the open buffer

    def emit(last: bool) -> Iterator[pa.RecordBatch]:
        """The buffers that go, of the rows held; with ``last`` the open one too."""
        nonlocal chunk, held
        table = pa.Table.from_batches(held).combine_chunks()
        lists = table["__t"].combine_chunks(), table["__m"].combine_chunks()
        offsets = lists[0].offsets.to_numpy()
        n = np.minimum(np.diff(offsets), size)
        ends, used = fit(n, size)
        if last and used:
            ends.append((len(n), used))
        taken = ends[-1][0] if ends else 0
        if ends:
            cuts = np.array([0, *(e for e, _ in ends)])
            row = np.repeat(np.arange(len(ends)), np.diff(cuts))
            before = np.cumsum(n[:taken]) - n[:taken]
            first = np.append(before, 0)[np.minimum(cuts[:-1], taken - 1)]
            inside = np.arange(int(n[:taken].sum())) - np.repeat(before, n[:taken])
            source = np.repeat(offsets[:taken], n[:taken]) + inside
            target = np.repeat(row * size + before - first[row], n[:taken]) + inside
            whole = []
            for values, fill in zip(lists, (PAD, 0), strict=True):
                out = np.full(len(ends) * size, fill, np.int32)
                out[target] = values.values.to_numpy()[source]
                whole.append(pa.ListArray.from_arrays(pa.array(np.arange(len(ends) + 1, dtype=np.int32) * size), pa.array(out)))
            numbers = [np.arange(chunk, chunk + len(ends)), np.diff(cuts), np.array([size - x for _, x in ends])]
            chunk += len(ends)
            yield pa.RecordBatch.from_arrays([pa.array([key] * len(ends), kind), pa.array(numbers[0]), *whole, pa.array(numbers[1]), pa.array(numbers[2])], [stream, "chunk", "tokens", "mask", "n_seqs", "n_pad"])
        held = table.slice(taken).to_batches()

    for b in batches:
        if not b.num_rows:
            continue
        kind = b[stream].type
        for k, lo, hi in stream_runs(b, stream):
            if held and k != key and flush:
                yield from emit(True)
            if k != key or chunk is None:
                chunk, held = 0, []
            key = k
            held.append(b.slice(lo, hi - lo))
            yield from emit(False)
    if held and flush:
        yield from emit(True)


def fit_lengths(lengths: Column, size: int) -> Column:
    """Next-fit on an array of lengths: struct<chunks, pad>. The last partial chunk counts. For a bounded array, such as a sample."""
    start = F.struct(F.lit(0).cast("long").alias("chunks"), F.lit(0).cast("long").alias("pad"), F.lit(0).cast("long").alias("used"))

    def step(acc: Column, n: Column) -> Column:
        n = F.least(n.cast("long"), F.lit(size).cast("long"))
        over = (acc.used > 0) & (acc.used + n > size)
        chunks = acc.chunks + F.when(over, 1).otherwise(0)
        pad = acc.pad + F.when(over, F.lit(size) - acc.used).otherwise(0)
        used = F.when(over, n).otherwise(acc.used + n)
        full = used == size
        return F.struct((chunks + F.when(full, 1).otherwise(0)).alias("chunks"), pad.alias("pad"), F.when(full, F.lit(0).cast("long")).otherwise(used).alias("used"))

    def finish(acc: Column) -> Column:
        left = acc.used > 0
        return F.struct((acc.chunks + F.when(left, 1).otherwise(0)).alias("chunks"), (acc.pad + F.when(left, F.lit(size) - acc.used).otherwise(0)).alias("pad"))

    return F.aggregate(lengths, start, step, finish)


def sim_pack(df: DataFrame, length: str, stream: str, order: list[str], size: int) -> DataFrame:
    """chunks, pad and sequences for each stream, by an ordered fold of one buffer's length."""
    own = df.select(stream, *order, F.col(length).cast("long").alias("__n")).repartition(stream).sortWithinPartitions(stream, *order)
    schema = T.StructType([df.schema[stream], T.StructField("chunks", T.LongType()), T.StructField("pad", T.LongType()), T.StructField("sequences", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[list] = []
        kind = pa.int64()
        for b in batches:
            if not b.num_rows:
                continue
            kind = b[stream].type
            lengths = np.minimum(b["__n"].to_numpy(), size)
            for k, lo, hi in stream_runs(b, stream):
                if not done or done[-1][0] != k:
                    done.append([k, 0, 0, 0, 0])
                own = done[-1]
                ends, own[4] = fit(lengths[lo:hi], size, own[4])
                own[1] += len(ends)
                own[2] += sum(size - n for _, n in ends)
                own[3] += hi - lo
        for own in done:
            if own[4]:
                own[1], own[2] = own[1] + 1, own[2] + size - own[4]
        columns = list(zip(*(x[:4] for x in done), strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (kind, pa.int64(), pa.int64(), pa.int64()), strict=True)], [stream, "chunks", "pad", "sequences"])

    return own.mapInArrow(run, schema)


def sections(chunk_cols: list[str], df: DataFrame, boundaries: dict[int, str]) -> DataFrame:
    """Role sections of chunks (columns tokens and mask): section, role ([MID-CONV] before the first boundary), n_tokens, trained."""
    marks = F.filter(F.transform("tokens", lambda t, i: F.when(t.isin(*boundaries), i)), lambda i: i.isNotNull())
    own = df.withColumn("__b", marks).where(F.size("tokens") > 0)
    whole = F.get("__b", 0) == 0
    own = own.withColumn("__s", F.when(whole, F.col("__b")).otherwise(F.concat(F.array(F.lit(0)), "__b"))).withColumn("__first", F.when(whole, 1).otherwise(0))
    end = lambda k: F.coalesce(F.get("__s", k + 1), F.size("tokens"))

    def section(at: Column, k: Column) -> Column:
        name = F.lit("[MID-CONV]")
        for i, role in boundaries.items():
            name = F.when(F.get("tokens", at) == i, F.lit(role)).otherwise(name)
        trained = F.array_contains(F.slice("mask", at + 1, end(k) - at), 1)
        return F.struct((k + F.col("__first")).cast("long").alias("section"), name.alias("role"), (end(k) - at).cast("long").alias("n_tokens"), trained.alias("trained"))

    return own.select(*chunk_cols, F.inline(F.transform("__s", section)))


def first_chunk(df: DataFrame, tokens: str, mask: str, stream: str, order: list[str], size: int) -> DataFrame:
    """The first aligned chunk of each stream, whole or not."""
    return aligned_chunks(df, tokens, mask, stream, order, size, flush=True).where("chunk = 0")
