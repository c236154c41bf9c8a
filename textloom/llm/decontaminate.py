"""Operator 8: benchmark passages in documents, by Wu-Manber multi-pattern search over words.

The patterns are the windows of ``width`` consecutive words of the benchmark items (an item of fewer words is one window).
For each window length there is a shift table: a block is two neighbouring words, and its entry says how far the search may
move on because no pattern has that block nearer to its end. Where the shift is 0, the bucket of that block (the suffix of the
patterns) is searched for the window's hash, and the words themselves are compared before anything counts. The search moves
through many segments of texts at once, each step one array operation.

Documents are only scanned, not shuffled. The benchmark is a query set: it goes to the executors in blocks of about
``block_words`` words or ``block_bytes`` bytes, whichever comes first (an item is not cut), one pass for each block; the usual
benchmark is one block. The tables of a block are arrays, of some 8 bytes for each byte of its text. Between passes the rows
are written with the hits so far and the block goes, so a worker and the driver hold two blocks at most.

Edge cases: null and empty texts have no words and no hits; repeated documents are rows of their own; the items of
repeated item ids count once; an item without an id marks words but is not counted or named; with an empty benchmark nothing is
hit. Columns of the documents with the names of the new ones are replaced.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.common import bounded_batches, discard, fresh, lean, mapped, stored
from textloom.llm.token_counts import slices
from textloom.llm.words import Words, mix, words

WIDTH = 10
WORD = "[0-9A-Za-z\\x{80}-\\x{10FFFF}]+"
BLOCK_WORDS = 2 << 20
BLOCK_BYTES = 16 << 20
SLICE_BYTES = 1 << 20
SEGMENT = 256
PIECE = 1 << 16
_A = np.uint64(0xD6E8FEB86659FD93)


class Patterns:
    """Shift table and buckets of the patterns of one length, as arrays: nothing is a Python object for each window.

    Equal windows are one pattern, kept as the place of its first window among the words of the block; the items of all
    patterns lie in one flat array.
    """

    def __init__(self, w: Words, codes: np.ndarray, rows: np.ndarray, length: int) -> None:
        self.length, self.block = length, min(2, length)
        self.data, self.start, self.end = w.data, w.start, w.end
        first, count = w.first[rows], w.first[rows + 1] - w.first[rows] - length + 1
        bits = max(12, int((count + length - 1).sum()).bit_length() + 3)
        self.down = np.uint64(64 - bits)
        self.shift = np.full(1 << bits, length - self.block + 1, np.uint8)
        for q in range(self.block - 1, length - 1):  # in order of falling shifts, so the least one stays
            self.shift[self.slot(w.hash, first + q)] = length - 1 - q
        at = (np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())).astype(w.start.dtype)
        key = np.empty(len(at), np.uint64)
        for k in range(0, len(at), PIECE):
            self.shift[self.slot(w.hash, at[k : k + PIECE] + (length - 1))] = 0
            key[k : k + PIECE] = self.key(w.hash, at[k : k + PIECE])
        order = np.argsort(key, kind="stable")
        key, at = key[order], at[order]
        new = np.ones(len(at), bool)
        near = np.flatnonzero(key[1:] == key[:-1]) + 1
        new[near] = ~self.same(w, at[near - 1], at[near])
        self.keys, self.at = key[new], at[new]
        owner = codes[np.searchsorted(w.first, at, "right") - 1]
        fresh_item = new.copy()
        fresh_item[1:] |= owner[1:] != owner[:-1]
        fresh_item &= owner >= 0
        self.items = owner[fresh_item]
        pattern = (np.cumsum(new) - 1)[fresh_item]
        self.of = np.searchsorted(pattern, np.arange(len(self.keys) + 1))

    def slot(self, hashed: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The slots of the blocks that end at the given words; a pattern of one word has blocks of one word."""
        own = hashed[last]
        return mix(own if self.block == 1 else hashed[last - 1] * _A + own) >> self.down

    def key(self, hashed: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Bucket (the slot of the last block) above, hash of all words below."""
        h = hashed[at]
        for k in range(1, self.length):
            h = mix(h * _A + hashed[at + k])
        return (self.slot(hashed, at + (self.length - 1)) << self.down) | (h >> (np.uint64(64) - self.down))

    def same(self, w: Words, here: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether the words from ``here`` on (of w) are those of the block from ``at`` on, byte by byte."""
        out = np.ones(len(here), bool)
        for lo in range(0, len(here), PIECE):
            alive = np.arange(lo, min(lo + PIECE, len(here)))
            for k in range(self.length):
                i, j = here[alive] + k, at[alive] + k
                n = w.end[i] - w.start[i]
                good = n == self.end[j] - self.start[j]
                good[good] = equal_spans(w.data, w.start[i[good]], self.data, self.start[j[good]], n[good])
                out[alive[~good]] = False
                alive = alive[good]
        return out

    def search(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """First word and pattern of each occurrence."""
        none = np.zeros(0, np.int64)
        first, last = w.first[:-1] + self.length - 1, w.first[1:]
        count = np.maximum(-(-(last - first) // SEGMENT), 0)
        if not count.sum():
            return none, none
        index = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        at = np.repeat(first, count) + index * SEGMENT
        end = np.minimum(at + SEGMENT, np.repeat(last, count))
        found = []
        while len(at):
            move = self.shift[self.slot(w.hash, at)]
            zero = move == 0
            if zero.any():
                found.append(at[zero])
            at = at + np.maximum(move, 1)
            go = at < end
            at, end = at[go], end[go]
        if not found:
            return none, none
        starts = np.concatenate(found) - (self.length - 1)
        key = self.key(w.hash, starts)
        lo, hi = np.searchsorted(self.keys, key, "left"), np.searchsorted(self.keys, key, "right")
        starts, pattern = np.repeat(starts, hi - lo), ranges(lo, hi)
        good = self.same(w, starts, self.at[pattern])
        return starts[good], pattern[good]


def equal_spans(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether a and b hold the same n bytes from the two places on, for each row; in pieces of bounded size."""
    out = np.ones(len(n), bool)
    done = 0
    ends = np.cumsum(n)
    while done < len(n):
        to = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + (16 * PIECE), "right")))
        m = n[done:to]
        if to == done + 1:  # perhaps a very long word
            x, y = int(a_at[done]), int(b_at[done])
            out[done] = np.array_equal(a[x : x + int(m[0])], b[y : y + int(m[0])])
        else:
            unlike = a[ranges(a_at[done:to], a_at[done:to] + m)] != b[ranges(b_at[done:to], b_at[done:to] + m)]
            out[done:to] = ~np.logical_or.reduceat(unlike, np.cumsum(m) - m)
        done = to
    return out


def ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All numbers from lo to hi - 1, row after row."""
    n = (hi - lo).astype(np.int64)
    return np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())


class Tables:
    """The patterns of a block of items: one ``Patterns`` for each length, and the ids of the items in byte order."""

    def __init__(self, block: pa.RecordBatch, width: int) -> None:
        w = words(block["text"])
        place = np.int32 if len(w.data) < 2**31 else np.int64
        w = Words(w.data, w.start.astype(place), w.end.astype(place), w.first, w.hash)
        ids = block["item"]
        known = ids.drop_null().unique()
        self.ids = known.take(pc.sort_indices(known))  # Arrow orders strings by their bytes
        codes = pc.fill_null(pc.index_in(ids, self.ids), -1).to_numpy(zero_copy_only=False).astype(np.int32)
        if ids.null_count:
            codes[ids.is_null().to_numpy(zero_copy_only=False)] = -1
        length = np.minimum(np.diff(w.first), width)
        self.patterns = [Patterns(w, codes, np.flatnonzero(length == n), int(n)) for n in np.unique(length[length > 0])]


_compiled: dict[str, Tables] = {}


def compiled(key: str, broadcast, width: int) -> Tables:
    """The tables of a pass, made once in each worker; those of another pass go before."""
    if key not in _compiled:
        _compiled.clear()
        _compiled[key] = Tables(broadcast.value, width)
    return _compiled[key]


def scan(texts: pa.Array, tables: Tables, before: pa.Array | None = None) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """For each text of a slice its number of words, its hit words (with those of ``before``) and the items with occurring windows."""
    w = words(texts)
    n = np.diff(w.first)
    change = np.zeros(len(w.hash) + 1, np.int64)
    pairs = [np.zeros(0, np.int64)]
    if before is not None:
        lists = pc.list_value_length(before).to_numpy(zero_copy_only=False).astype(np.int64)
        earlier = np.repeat(w.first[:-1], lists) + before.flatten().to_numpy(zero_copy_only=False)
        change[earlier] += 1
        change[earlier + 1] -= 1
    most = max(1, len(tables.ids))
    for t in tables.patterns:
        start, pattern = t.search(w)
        change += np.bincount(start, minlength=len(change)) - np.bincount(start + t.length, minlength=len(change))
        doc = np.searchsorted(w.first, start, "right") - 1
        both = np.unique(doc * len(t.keys) + pattern)  # a document names the items of a pattern once
        doc, pattern = both // max(1, len(t.keys)), both % max(1, len(t.keys))
        lo, hi = t.of[pattern], t.of[pattern + 1]
        pairs.append(np.unique(np.repeat(doc, hi - lo) * most + t.items[ranges(lo, hi)]))
    hit = np.flatnonzero(np.cumsum(change[:-1]) > 0)
    cut = np.searchsorted(hit, w.first)
    own = hit - np.repeat(w.first[:-1], np.diff(cut))
    hits = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(own, pa.int32()))
    named = np.unique(np.concatenate(pairs))
    cut = np.searchsorted(named // most, np.arange(len(n) + 1))
    items = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), tables.ids.take(pa.array(named % most)))
    return n, hits, items


def blocks(bench: DataFrame, item_id: str, text: str, block_words: int, block_bytes: int) -> Iterator[pa.RecordBatch]:
    """The items in blocks of bounded size."""
    held, n, size = [], 0, 0
    own = F.col(f"`{text}`").cast("string")
    for r in bench.select(F.col(f"`{item_id}`").cast("string").alias("i"), own.alias("t"), F.regexp_count(own, F.lit(WORD)).alias("n"), F.octet_length(own).alias("size")).toLocalIterator(prefetchPartitions=True):
        held.append((r.i, r.t))
        n, size = n + (r.n or 0), size + (r.size or 0)
        if n >= block_words or size >= block_bytes:
            yield as_block(held)
            held, n, size = [], 0, 0
    if held:
        yield as_block(held)


def as_block(items: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([i for i, _ in items], pa.string()), pa.array([t for _, t in items], pa.large_string())], ["item", "text"])


def contamination(
    docs: DataFrame, bench: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WIDTH,
    columns: list[str] | None = None, block_words: int = BLOCK_WORDS, block_bytes: int = BLOCK_BYTES, slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """``columns`` of the documents (all, unless given) plus n_words, hits (positions of the words inside occurrences of
    windows) and item_ids (of the items with occurring windows, as strings, in order)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    new = ["n_words", "hits", "item_ids"]
    columns = [c for c in (docs.columns if columns is None else columns) if c not in new]
    kept = [docs.schema[c] for c in columns]
    added = [T.StructField("n_words", T.LongType()), T.StructField("hits", T.ArrayType(T.IntegerType())), T.StructField("item_ids", T.ArrayType(T.StringType()))]
    all_blocks = blocks(bench, item_id, item_text, block_words, block_bytes)
    block = next(all_blocks, as_block([]))
    hidden = fresh("text", [*columns, *new])
    df, earlier = docs.select(*[F.col(f"`{c}`") for c in columns], F.col(f"`{text}`").cast("string").alias(hidden)), None
    while block is not None:
        after = next(all_blocks, None)
        fields = [*kept, *([T.StructField(hidden, T.StringType())] if after is not None else []), *added]
        shared = spark.sparkContext.broadcast(block)
        run = one_pass(uuid.uuid4().hex, shared, hidden, [f.name for f in fields], earlier is not None, width, slice_bytes)
        df = mapped(df, run, T.StructType(fields))
        if after is not None:
            df = stored(df, "hits")
            shared.destroy()
            if earlier is not None:
                discard(earlier)
            earlier = df
        block = after
    return df


def one_pass(key: str, broadcast, hidden: str, names: list[str], more: bool, width: int, slice_bytes: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = compiled(key, broadcast, width)
        for b in batches:
            if not b.num_rows:
                continue
            texts = b[hidden].cast(pa.large_string())
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
            done = [scan(texts.slice(at, to - at), tables, b["hits"].slice(at, to - at) if more else None) for at, to in slices(sizes, slice_bytes)]
            n, hits, items = (list(x) for x in zip(*done, strict=True))
            items = pa.concat_arrays(items)
            if more and len(b["item_ids"].flatten()):
                items = pa.array([sorted({*x, *y}, key=str.encode) for x, y in zip(items.to_pylist(), b["item_ids"].to_pylist(), strict=True)], items.type)
            made = {"n_words": pa.array(np.concatenate(n), pa.int64()), "hits": pa.concat_arrays(hits), "item_ids": items}
            yield pa.RecordBatch.from_arrays([made[c] if c in made else b[c] for c in names], names)

    return run
