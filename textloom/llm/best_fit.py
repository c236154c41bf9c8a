"""Operator 12: best-fit packing under several capacities.

A bin has room for so many tokens, documents and attention cost (the sum of squared lengths, as each piece attends to itself). Longest pieces go first. A piece goes to the bin that
suits it best of those that have room in every respect: by the least weighted norm of what would be left (``norm``), or by the largest weighted dot product of the piece's demand and what is
left (``dot``), each as a share of its capacity. Where no bin has room, a new one is opened.

1. Texts are encoded where they lie. A document becomes full pieces, a bin each, and a last piece, which waits. Only numbers are written: a row for each piece.
2. Waiting pieces are dealt at random (by a hash of their number) into lots of about ``LOT``, each placed by itself from the longest to the shortest. A task holds one lot at a time.
3. The up to ``KEPT`` emptiest bins of each lot are opened again, and the pieces of ``MERGE`` lots are placed together, in rounds, until one lot is left. Where that takes no fewer bins than
   before, bins stay as they were.

Sequence ids are those of the task, or of the lot, that made the bin; ids of pieces come from files and partitions, so a lost task makes the same rows again.

Edge cases: a null text is an empty one, a document of just the end id; repeated rows are packed as often as they occur; a null doc_id stays null; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import bounded_batches, gathered, lean, parts, runs, stored
from textloom.llm.packing import SLICE_BYTES, encoder, task_base, whole_ids
from textloom.llm.token_counts import slices

LOT = 16_384
KEPT = 64
MERGE = 16
WEIGHTS = (1.0, 0.01, 0.01)

PIECE = ["doc_id", "piece", "start", "length", "ids_crc32", "number", "sequence_id", "offset"]
SCHEMA = ", ".join(f"{c} long" for c in PIECE)
PLACED = SCHEMA + ", lot long, is_open boolean"


def placed(lengths: np.ndarray, room: np.ndarray, weights: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bin and the offset of each piece, for pieces from the longest to the shortest; and what is left in each bin.

    ``room`` has the capacities for tokens, documents and attention cost. A piece that is too much for an empty bin is an error."""
    n = len(lengths)
    demand = np.stack([lengths, np.ones(n, np.int64), lengths * lengths], 1)
    if n and (demand.max(0) > room).any():
        raise ValueError(f"a piece needs {demand.max(0).tolist()} of {room.tolist()}")
    left = np.zeros((n, 3), np.int64)  # by bin
    opened = np.zeros(0, np.int64)  # bins with room for the shortest piece
    least = demand.min(0) if n else room
    bins, offset, made = np.zeros(n, np.int64), np.zeros(n, np.int64), 0
    space = np.zeros((0, 3), np.int64)  # of the opened bins
    for i in range(n):
        d = demand[i]
        fits = np.flatnonzero(space[:, 0] >= d[0])
        if len(fits):
            own = space[fits]
            fits = fits[(own[:, 1] >= d[1]) & (own[:, 2] >= d[2])]
        if len(fits):
            if rule == "dot":
                at = fits[np.argmax((space[fits] / room) @ (weights * d / room))]
            else:
                rest = (space[fits] - d) / room
                at = fits[np.argmin((rest * rest) @ weights)]
            b = opened[at]
        else:
            b, at = made, -1
            left[b], made = room, made + 1
        bins[i], offset[i] = b, room[0] - left[b, 0]
        left[b] -= d
        if (left[b] >= least).all():
            if at < 0:
                opened, space = np.append(opened, b), np.concatenate([space, left[b : b + 1]])
            else:
                space[at] = left[b]
        elif at >= 0:
            opened, space = np.delete(opened, at), np.delete(space, at, 0)
    return bins, offset, left[:made]


def pieces(df: DataFrame, tokenizer_file: str, end_id: int, size: int, slice_bytes: int) -> DataFrame:
    """The pieces of each document. Full ones have a sequence of their own, others none yet."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, number, rows = encoder(tokenizer_file), task_base(0), []
        tail = end_id.to_bytes(4, "little")

        def sent() -> pa.RecordBatch:
            columns = zip(*rows, strict=True) if rows else [[]] * len(PIECE)
            out = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], PIECE)
            rows.clear()
            return out

        for b in gathered(batches, slice_bytes):
            texts = pc.fill_null(b[1].cast(pa.large_string()), "")
            sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
            docs = b[0].to_pylist()
            for at, to in slices(sizes, slice_bytes):
                for doc, ids in zip(docs[at:to], whole_ids(own, texts, at, to, int(sizes[at]), slice_bytes), strict=True):
                    raw = ids + tail
                    for piece, start in enumerate(range(0, len(raw) // 4, size)):
                        cut = raw[4 * start : 4 * (start + size)]
                        full = len(cut) == 4 * size
                        rows.append((doc, piece, start, len(cut) // 4, zlib.crc32(cut), number, number if full else None, 0 if full else None))
                        number += 1
                if len(rows) > 2_000:
                    yield sent()
        yield sent()

    return df.mapInArrow(run, SCHEMA)


def filled(waiting: DataFrame, lots: int, room: np.ndarray, weights: np.ndarray, rule: str, stage: int, kept: int) -> DataFrame:
    """Places the pieces of each lot. Those of up to ``kept`` bins come back open."""

    def fill(table: pa.Table) -> Iterator[pa.RecordBatch]:
        lot = table["lot"].to_numpy()
        cuts = np.flatnonzero(np.concatenate(([True], lot[1:] != lot[:-1], [True])))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            own = table.slice(int(a), int(b - a)).combine_chunks()
            bins, offset, left = placed(own["length"].to_numpy(), room, weights, rule)
            sequence = (stage << 58) + (int(lot[a]) << 24) + bins
            if stage > 1:
                before, first = np.unique(own["sequence_id"].to_numpy(), return_inverse=True)
                if len(before) <= len(left):
                    sequence, offset, bins = own["sequence_id"].to_numpy(), own["offset"].to_numpy(), first
                    used = np.stack([np.bincount(first, w).astype(np.int64) for w in (own["length"].to_numpy(), np.ones(len(own)), own["length"].to_numpy() ** 2)], 1)
                    left = room - used
            emptiest = np.argsort(-left[:, 0], kind="stable")[:kept]
            again = np.zeros(len(left), bool)
            again[emptiest[left[emptiest, 0] > 0]] = True
            columns = [own[c].combine_chunks() for c in PIECE[:6]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset), own["lot"].combine_chunks(), pa.array(again[bins])], [*PIECE, "lot", "is_open"])

    n = parts(lots, 12, min(lots, int(waiting.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    dealt = waiting.repartition(n, "lot").sortWithinPartitions("lot", F.desc("length"), "number")
    return dealt.mapInArrow(lambda batches: runs(batches, ["lot"], fill), PLACED)


def fill(
    df: DataFrame, tokenizer_file: str, *, doc_id: str = "doc_id", text: str = "text", end_id: int = 0, size: int = 2048, documents: int | None = None, attention: int | None = None,
    weights: tuple[float, float, float] = WEIGHTS, rule: str = "norm", lot: int = LOT, kept: int = KEPT, slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """One row for each piece of a document: doc_id, piece (from 0), start (its document's ids before it), length, ids_crc32 (of the ids as little-endian unsigned 32-bit
    numbers), sequence_id, offset there.

    A sequence has at most ``size`` tokens, ``documents`` pieces and ``attention`` cost. Left out, the last two are what ``size`` tokens can come to, so that they bind nothing and
    there are as few sequences as there can be. ``attention`` is ``size ** 2`` at least, the cost of a full piece."""
    if rule not in ("norm", "dot"):
        raise ValueError(f"no such rule: {rule!r}")
    room = np.array([size, documents or size, attention or size * size], np.int64)
    if room[2] < size * size:
        raise ValueError("a full piece costs size ** 2")
    own_weights = np.array(weights)
    bounded_batches(df.sparkSession)
    source = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    done = stored(pieces(source, tokenizer_file, end_id, size, slice_bytes), "pieces")
    waiting = done.where("sequence_id is null")
    lots, stage = parts(waiting.count(), lot), 1
    waiting = waiting.withColumn("lot", F.pmod(F.xxhash64("number"), F.lit(lots).cast("long")))
    results = [done.where("sequence_id is not null")]
    while True:
        last = lots == 1
        out = stored(filled(waiting, lots, room, own_weights, rule, stage, 0 if last else kept), "placed")
        results.append(out.where("not is_open").select(PIECE))
        if last:
            break
        lots, stage = -(-lots // MERGE), stage + 1
        waiting = out.where("is_open").withColumn("lot", F.floor(F.col("lot") / MERGE)).drop("is_open")
    found = results[0]
    for r in results[1:]:
        found = found.unionByName(r)
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
