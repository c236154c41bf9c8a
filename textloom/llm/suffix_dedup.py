"""Operator 6: passages that documents share, by sparse suffix arrays over words.

A suffix is kept where a run of ``GRAM`` words has the least hash of ``WINDOW`` neighbouring runs. That choice depends on the words alone, so
a passage of GRAM + WINDOW - 1 words keeps the same suffixes wherever it stands. Suffixes whose first run occurs in one document
only are dropped by their hashes, before any context is made. The others get the ``min_words`` words from there and as many before as a passage can have there, as
24-bit hashes, and are sorted by the words to the right. Each is compared with its neighbours from other documents: for each number of words to the
right that it shares, with those that share most words to the left. A match counts if it has ``min_words`` words. The matches of a document are merged, so longer passages
come from the overlapping matches of their suffixes.

Documents with the same text are one class: each is a passage from end to end, and one of them takes part in the search, for the others.

Suffixes with the same first words are one group. Groups under ``chunk`` rows (a thousandth of all, ``LEAST_CHUNK`` at least and ``CHUNK`` at most) are dealt by those words' hash
and compared whole. Larger ones are decided without bringing them together: each of their suffixes gives a 64-bit hash for every stretch of ``min_words`` words around it in which no other run of
``GRAM`` words has a lower hash, so a document gives each stretch once, and a stretch counts if another document gives the same one. Hashes of over a thousandth of these rows are decided where they lie, so a passage that many documents share is spread over tasks.
Both ways find every stretch of ``min_words`` words that two documents share, so the result doesn't depend on ``chunk`` or on partitions.

Edge cases: null texts and those under ``min_words`` words have no spans; repeats within one document don't count; rows that repeat a doc_id
are the same document, and each has spans of its own; rows without a doc_id have no spans; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import among, bounded_batches, lean, parts, stored
from textloom.llm.token_counts import slices
from textloom.llm.words import windows, words

MIN_WORDS = 50
GRAM = 16
WINDOW = 32
BITS = 24
SLICE_BYTES = 1 << 20
CHUNK, LEAST_CHUNK = 20_000, 1000
ROWS_EACH = 500_000


def minimisers(h: np.ndarray) -> np.ndarray:
    """Positions that hold the least value of some ``WINDOW`` neighbours."""
    n = len(h) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    low, step = h, 1
    while step < WINDOW:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    high = np.concatenate((np.zeros(WINDOW - 1, np.uint64), low, np.zeros(WINDOW - 1, np.uint64)))
    step = 1
    while step < WINDOW:
        high = np.maximum(high[:-step], high[step:])
        step *= 2
    return np.flatnonzero(high == h)


@lean
def chosen(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    """The kept suffixes of each document: the hashes of their first words, each with its positions."""
    for b in batches:
        texts = pc.fill_null(b["text"].cast(pa.large_string()), "")
        for at, to in slices(pc.binary_length(texts).to_numpy(zero_copy_only=False), SLICE_BYTES):
            w = words(texts.slice(at, to - at))
            h, _, first = windows(w, GRAM)
            count = np.diff(w.first)
            pos, hashes, size, per = [], [], [], []
            for i in range(to - at):
                p = minimisers(h[first[i] : first[i + 1]]) if count[i] >= min_words else np.zeros(0, np.int64)
                own, inverse, n = np.unique(h[first[i] + p], return_inverse=True, return_counts=True)
                pos.append(p[np.argsort(inverse, kind="stable")].astype(np.int32))
                hashes.append(own.view(np.int64))
                size.append(n)
                per.append(len(own))
            outer = pa.array(np.concatenate(([0], np.cumsum(per))).astype(np.int32))
            inner = pa.array(np.concatenate(([0], np.cumsum(np.concatenate([*size, np.zeros(0, np.int64)])))).astype(np.int32))
            places = pa.ListArray.from_arrays(outer, pa.ListArray.from_arrays(inner, pa.array(np.concatenate([*pos, np.zeros(0, np.int32)]))))
            lists = [places, pa.ListArray.from_arrays(outer, pa.array(np.concatenate([*hashes, np.zeros(0, np.int64)])))]
            yield pa.RecordBatch.from_arrays([b["id"].slice(at, to - at), b["mark"].slice(at, to - at), b["t1"].slice(at, to - at), b["t2"].slice(at, to - at), pa.array(count), *lists], ["id", "mark", "t1", "t2", "n_words", "pos", "h"])


def reach(min_words: int) -> tuple[int, int]:
    """Words to the right and to the left of a suffix that a stretch of ``min_words`` words around it can have."""
    return min_words, min_words - GRAM


@lean
def contexts(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    """The words to the right of each position, then those to the left, nearest first, and how many of each there are. A word is three bytes."""
    most_right, most_left = reach(min_words)
    for b in batches:
        texts = b["text"].cast(pa.large_string())
        for at, to in slices(pc.binary_length(texts).to_numpy(zero_copy_only=False), SLICE_BYTES):
            w = words(texts.slice(at, to - at))
            grams, _, first = windows(w, GRAM)
            short = (w.hash >> np.uint64(64 - BITS)).astype(np.uint32)
            lists = b["pos"].slice(at, to - at)
            n = lists.value_lengths().to_numpy()
            row = np.repeat(np.arange(to - at), n)
            pos = lists.flatten().to_numpy()
            middle = w.first[row] + pos
            ends = np.stack((np.minimum(w.first[row + 1] - middle, most_right), np.minimum(pos, most_left)), 1)
            least = least_of(grams, first[row] + pos, first[row], first[row + 1], most_left)
            ends = np.concatenate((ends, np.minimum(least + (0, GRAM), ends[:, ::-1])), 1).astype(np.int32)
            for lo in range(0, len(pos), CHUNK):
                mid, own, size = middle[lo : lo + CHUNK], row[lo : lo + CHUNK], ends[lo : lo + CHUNK]
                k = np.arange(most_right)
                right = np.where(k < size[:, :1], short[np.minimum(mid[:, None] + k, len(short) - 1)], 0)
                k = np.arange(most_left)
                left = np.where(k < size[:, 1:2], short[np.maximum(mid[:, None] - 1 - k, 0)], 0)
                whole = np.concatenate((right, left), 1).astype(">u4")
                raw = whole.view(np.uint8).reshape(*whole.shape, 4)[:, :, 1:].tobytes()
                wide = 3 * whole.shape[1]
                context = pa.array([raw[i : i + wide] for i in range(0, len(raw), wide)], pa.binary())
                hashes, large = (b[c].slice(at, to - at).flatten().slice(lo, CHUNK) for c in ("h", "large"))
                yield pa.RecordBatch.from_arrays(
                    [hashes, large, context, b["id"].slice(at, to - at).take(pa.array(own)), b["mark"].slice(at, to - at).take(pa.array(own)), pa.array(pos[lo : lo + CHUNK]), *[pa.array(np.ascontiguousarray(size[:, c])) for c in range(4)]],
                    ["h", "large", "context", "id", "mark", "pos", "n_right", "n_left", "own_left", "own_right"],
                )


def least_of(h: np.ndarray, at: np.ndarray, first: np.ndarray, end: np.ndarray, most: int) -> np.ndarray:
    """How many runs to the left of each position, and to the right, have no lower hash (to the left no equal one either), ``most`` at most."""
    out = np.zeros((len(at), 2), np.int64)
    left, right = np.ones(len(at), bool), np.ones(len(at), bool)
    for k in range(1, most + 1):
        left &= (at - k >= first) & (h[np.maximum(at - k, 0)] > h[at])
        right &= (at + k < end) & (h[np.minimum(at + k, len(h) - 1)] >= h[at])
        out[:, 0] += left
        out[:, 1] += right
    return out


SUFFIX = "h long, large boolean, context binary, id long, mark long, pos int, n_right int, n_left int, own_left int, own_right int"
MATCH = "id long, mark long, start int, end int, other long"


@lean
def matches(batches: Iterator[pa.RecordBatch], min_words: int, size: int) -> Iterator[pa.RecordBatch]:
    """Matches of a sorted stream, in chunks of whole groups (equal first words), of about ``size`` rows."""
    waiting: list[pa.RecordBatch] = []
    n = 0

    def chunk(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal n
        table = pa.Table.from_batches(waiting).combine_chunks()
        waiting.clear()
        h = table["h"].to_numpy()
        new = np.flatnonzero(h[1:] != h[:-1]) + 1
        cut = len(h) if last else int(new[-1]) if len(new) else 0
        yield from compared(table.slice(0, cut).combine_chunks(), min_words)
        waiting.extend(table.slice(cut).combine_chunks().to_batches())
        n = len(h) - cut

    for b in batches:
        if b.num_rows:
            waiting.append(b)
            n += b.num_rows
            if n >= size:
                yield from chunk(False)
    if waiting:
        yield from chunk(True)


def lengths(equal: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many leading columns are true, ``most`` at most."""
    return np.minimum(np.where(equal.all(1), equal.shape[1], (~equal).argmax(1)), most)


def compared(table: pa.Table, min_words: int) -> Iterator[pa.RecordBatch]:
    """Matches of the rows of whole groups.

    For each number r of words to the right, rows with the same r words are neighbours in the order of their words to the left, so the
    nearest ones from other documents match farthest to the left. r grows as the sorted array's common prefixes tell."""
    n = table.num_rows
    if n < 2:
        return
    h, ids, pos = (table[c].to_numpy() for c in ("h", "id", "pos"))
    most_right, most_left = reach(min_words)
    raw = np.frombuffer(b"".join(table["context"].to_pylist()), np.uint8).reshape(n, -1, 3)
    own = (raw[:, :, 0].astype(np.uint32) << 16) | (raw[:, :, 1].astype(np.uint32) << 8) | raw[:, :, 2]
    right, left = own[:, :most_right], own[:, most_right:]
    n_right, n_left = table["n_right"].to_numpy(), table["n_left"].to_numpy()
    common = np.zeros(n, np.int64)
    common[1:] = np.where(h[1:] == h[:-1], lengths(right[1:] == right[:-1], np.minimum(n_right[1:], n_right[:-1])), 0)
    rank = np.empty(n, np.int64)
    rank[np.argsort(np.ascontiguousarray(raw[:, most_right:]).reshape(n, -1).view(f"S{3 * most_left}")[:, 0], kind="stable")] = np.arange(n)
    best = np.full((most_right + 2 - GRAM, n), -1, np.int16)
    partner = np.zeros((most_right + 2 - GRAM, n), np.int64)
    for r in range(GRAM, most_right + 1):
        group = np.cumsum(common < r)
        rows = np.flatnonzero(np.bincount(group)[group] > 1)
        if not len(rows):
            break
        rows = rows[np.lexsort((ids[rows], rank[rows], group[rows]))]
        g, d = group[rows], ids[rows]
        new = np.concatenate(([True], (g[1:] != g[:-1]) | (d[1:] != d[:-1])))
        starts = np.flatnonzero(new)
        run = np.cumsum(new) - 1
        for other in (starts[run] - 1, np.append(starts[1:], len(rows))[run]):
            i = np.flatnonzero((other >= 0) & (other < len(rows)))
            i = i[g[i] == g[other[i]]]
            a, b = rows[i], rows[other[i]]
            far = lengths(left[a] == left[b], np.minimum(n_left[a], n_left[b]))
            better = far > best[r - GRAM, a]
            best[r - GRAM, a[better]] = far[better]
            partner[r - GRAM, a[better]] = ids[b[better]]
    r = np.arange(GRAM, most_right + 1)[:, None]
    corner = (best[:-1] >= 0) & (best[:-1] + r >= min_words) & (best[1:] < best[:-1])
    k, i = np.nonzero(corner)
    if not len(i):
        return
    start, end, other = pos[i] - best[k, i], pos[i] + k + GRAM, partner[k, i]
    # spans of one document that touch become one, so a document repeated throughout sends a few rows
    _, doc = np.unique(table["mark"].to_numpy()[i], return_inverse=True)
    order = np.lexsort((end, start, doc))
    i, start, end, other, doc = i[order], start[order].astype(np.int64), end[order].astype(np.int64), other[order], doc[order]
    apart = doc.astype(np.int64) << 32
    furthest = np.maximum.accumulate(apart + end)
    new = np.concatenate(([True], apart[1:] + start[1:] > furthest[:-1]))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(i)) - 1
    stop = furthest[last] - apart[last]
    for lo in range(0, len(first), CHUNK):
        at = first[lo : lo + CHUNK]
        yield found(table, i[at], start[at], stop[lo : lo + CHUNK], other[at])


MATCH_NAMES = [c.split()[0] for c in MATCH.split(", ")]


def found(table: pa.Table, i: np.ndarray, start: np.ndarray, end: np.ndarray, other: np.ndarray) -> pa.RecordBatch:
    """Matches of the rows i."""
    own = [table[c].combine_chunks().take(pa.array(i)) for c in MATCH_NAMES[:2]]
    more = [pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)), pa.array(other.astype(np.int64))]
    return pa.RecordBatch.from_arrays([*own, *more], MATCH_NAMES)


HIT = "id long, mark long, pos int, start int, end int, other long"
HIT_NAMES = [c.split()[0] for c in HIT.split(", ")]


@lean
def in_two(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows whose key another document has too, each with one that has it, of a stream that is sorted by key and document. Rows wait only while all of their
    key are of one document."""
    waiting: list[pa.RecordBatch] = []
    known: tuple[int, int, int] | None = None  # the open key, its first document and another one
    for b in batches:
        if not b.num_rows:
            continue
        table = pa.Table.from_batches([*waiting, b]).combine_chunks()
        key, ids = table["key"].to_numpy(), table["id"].to_numpy()
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.append(start, len(key)))
        first, last = ids[start], ids[start + size - 1]
        if known is not None and key[0] == known[0]:
            first[0] = known[1]
            last[0] = known[2] if known[2] != known[1] else last[0]
        shared = np.repeat(first != last, size)
        rows = np.flatnonzero(shared)
        some = np.repeat(first, size)
        other = np.where(ids == some, np.repeat(last, size), some)
        yield hit_rows(table, rows, other[rows])
        known = (int(key[-1]), int(first[-1]), int(last[-1])) if shared[-1] else None
        waiting = [] if shared[-1] else table.slice(int(start[-1])).to_batches()


def in_common(batches: Iterator[pa.RecordBatch], common: list[tuple[int, int, int]]) -> Iterator[pa.RecordBatch]:
    """The rows of the given keys (each with its least and greatest document) that two documents have."""
    keys, least, most = (np.array(c, np.int64) for c in zip(*common, strict=True))
    for b in batches:
        if b.num_rows:
            at, ids = np.searchsorted(keys, b["key"].to_numpy()), b["id"].to_numpy()
            rows = np.flatnonzero(least[at] != most[at])
            yield hit_rows(pa.Table.from_batches([b]), rows, np.where(ids == least[at], most[at], least[at])[rows])


def hit_rows(table: pa.Table, rows: np.ndarray, other: np.ndarray) -> pa.RecordBatch:
    own = [table[c].combine_chunks().take(pa.array(rows)) for c in HIT_NAMES[:-1]]
    return pa.RecordBatch.from_arrays([*own, pa.array(other)], HIT_NAMES)


def stretches(suffixes: DataFrame, min_words: int, chunk: int) -> DataFrame:
    """Spans (id, mark, start, end, other) of the suffixes in large groups: every stretch of ``min_words`` words around a suffix whose first words have the least hash in it, that
    another document has."""
    sides = [(r, min_words - r) for r in range(GRAM, min_words + 1)]
    own = [
        F.when(
            (F.col("own_right") >= r) & (F.col("own_left") >= l),
            F.struct(F.xxhash64("h", F.lit(r), F.substring("context", 1, 3 * r), F.substring("context", 3 * reach(min_words)[0] + 1, 3 * l)).alias("key"), (F.col("pos") - l).alias("start"), (F.col("pos") + r).alias("end")),
        )
        for r, l in sides
    ]
    each = suffixes.select("id", "mark", "pos", F.explode(F.filter(F.array(*own), lambda x: x.isNotNull())).alias("s")).select("s.key", "id", "mark", "pos", "s.start", "s.end")
    most = max(chunk, each.count() // 1000)
    often = each.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count("*").alias("n")).where(F.col("n") > most)
    common = sorted(tuple(r) for r in often.select("key", "a", "b").collect())  # fewer than 1000
    rare = each.where(~F.col("key").isin([k for k, _, _ in common])) if common else each
    n = parts(each.count(), ROWS_EACH, int(suffixes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    hits = rare.repartition(n, "key").sortWithinPartitions("key", "id").mapInArrow(in_two, HIT)
    if common:
        hits = hits.unionByName(each.where(F.col("key").isin([k for k, _, _ in common])).mapInArrow(lambda b: in_common(b, common), HIT))
    near = F.floor(F.col("pos") / GRAM)  # stretches around suffixes this near overlap: each holds the GRAM words from its suffix on
    return hits.groupBy("id", "mark", near).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("other").alias("other")).select("id", "mark", "start", "end", "other")


def repeated_spans(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, chunk: int | None = None) -> DataFrame:
    """doc_id, n_words, n_repeated (words in passages of at least ``min_words`` words that other documents hold) and spans, an array of
    start, end (word positions, the end outside) and other (a document with a part of it)."""
    if min_words < GRAM + WINDOW - 1:
        raise ValueError(f"passages of under {GRAM + WINDOW - 1} words may hold no suffix")
    bounded_batches(docs.sparkSession)
    own = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text")).withColumns({"mark": F.xxhash64("id", "text"), "t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit(1), "text")})
    kept = stored(own.mapInArrow(lambda b: chosen(b, min_words), "id long, mark long, t1 long, t2 long, n_words long, pos array<array<int>>, h array<long>"), "suffixes")
    known = kept.where(F.col("id").isNotNull() & (F.col("n_words") >= min_words)).select("id", "mark", "t1", "t2", "n_words")
    classes = known.groupBy("t1", "t2").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b")
    copies = stored(known.join(classes, ["t1", "t2"]).select("id", "mark", "n_words", "a", F.when(F.col("id") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("other")).distinct(), "copies")
    alone = among(kept.where("id is not null"), copies.where("id != a").select("id", "mark"), ["id", "mark"], "left_anti")
    each = alone.select("id", "mark", F.inline(F.arrays_zip("pos", "h")))
    shared = stored(each.groupBy("h").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.sum(F.size("pos")).alias("n")).where("a < b").select("h", "n"), "shared")
    chunk = chunk or min(CHUNK, max(LEAST_CHUNK, (shared.agg(F.sum("n")).first()[0] or 0) // 1000))
    shared = shared.select("h", (F.col("n") >= chunk).alias("large"))
    places = each.join(shared, "h").groupBy("id", "mark").agg(F.collect_set(F.struct("pos", "h", "large")).alias("at"))
    every = F.flatten(F.transform("at", lambda x: F.transform(x.pos, lambda p: F.struct(p.alias("pos"), x.h.alias("h"), x.large.alias("large")))))
    placed = places.select("id", "mark", every.alias("at")).select("id", "mark", F.col("at.pos").alias("pos"), F.col("at.h").alias("h"), F.col("at.large").alias("large"))
    suffixes = stored(own.select("id", "mark", "text").join(placed, ["id", "mark"]).dropDuplicates(["id", "mark"]).select("id", "mark", "text", "pos", "h", "large").mapInArrow(lambda b: contexts(b, min_words), SUFFIX), "contexts")
    n = parts(suffixes.count(), ROWS_EACH, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sorted_ = suffixes.where("not large").repartition(n, "h").sortWithinPartitions("h", "context", "id", "pos")
    spans = sorted_.mapInArrow(lambda b: matches(b, min_words, chunk), MATCH).select("id", "mark", "start", "end", "other")
    large = suffixes.where("large")
    if not large.isEmpty():
        spans = spans.unionByName(stretches(large, min_words, chunk))
    whole = copies.select("id", "mark", F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end"), "other")
    spans = stored(spans.unionByName(whole), "matches")
    before = Window.partitionBy("id", "mark").orderBy("start", "end", "other").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("id", "mark").orderBy("start", "end", "other").rowsBetween(Window.unboundedPreceding, 0)
    merged = (
        spans.withColumn("new", F.when(F.col("start") <= F.max("end").over(before), 0).otherwise(1)).withColumn("island", F.sum("new").over(upto))
        .groupBy("id", "mark", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("other").alias("other"))
        .groupBy("id", "mark").agg(F.sort_array(F.collect_list(F.struct("start", "end", "other"))).alias("spans"), F.sum(F.col("end") - F.col("start")).alias("n"))
    )
    return kept.select("id", "mark", "n_words").join(merged, ["id", "mark"], "left").select(
        F.col("id").alias("doc_id"), "n_words", F.coalesce("n", F.lit(0)).cast("long").alias("n_repeated"), F.coalesce("spans", F.array().cast("array<struct<start:int,end:int,other:bigint>>")).alias("spans")
    )
