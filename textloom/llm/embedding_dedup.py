"""Operator 1: near-duplicate vectors.

Random hyperplanes give each vector a row of sign bits; each of several tables takes some of them as its code. Vectors with the same bytes are one
class, which takes part once. Classes with the same code in a table meet twice:

Search. Only their ids and bits meet, all pairs of a bucket at once. A pair is a candidate if its bits differ in no more places than those of a
pair at the threshold do (but once in 300,000), and in the first table only where its codes agree, so no pair comes up twice.

Verification. Only classes with a candidate in a bucket go there again, with their vectors, for the exact cosine. Buckets emit a row for each class with
links (the number of linked vectors, and the least id that its links reach within the bucket), never pairs; components of these stars are the
components of the links.

The number of bits of a code follows the number of rows (about ``BUCKET`` of unrelated rows share one), and the number of tables follows from
the bits: so many that a pair at the threshold itself is missed with a probability of 1 - ``recall``; closer pairs are missed less often.
A bucket above ``BLOCK`` rows is cut into chunks, and each pair of chunks is a task's work of its own.

Edge cases: a vector that is null, empty or zero, or holds null or non-finite components, links with nothing; so does one of another
length. Rows that repeat an id are one vector (the least one that isn't null); rows without an id come back with no links and a null
component, one for each of them. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import among, bounded_batches, bounds, dealt, discard, lean, runs, stored
from textloom.llm.components import components

BUCKET = 1024
BLOCK = 2048
LEAST_BITS = 256
RECALL = 0.995
SIGMAS = 4.5
ROWS_AT_ONCE = 256
SEED = 20_240


def layout(rows: int, threshold: float, recall: float) -> tuple[int, int]:
    """Bits of a code, and tables."""
    bits = min(30, max(4, round(math.log2(max(rows, 1) / BUCKET))))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - agree)))


def most_apart(size: int, threshold: float) -> int:
    """Bits of ``size`` in which the signs of two vectors at the threshold differ, at most."""
    share = math.acos(threshold) / math.pi
    return math.ceil(size * share + SIGMAS * math.sqrt(size * share * (1 - share)))


def linked(df: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", threshold: float = 0.9, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept for each vector."""
    bounded_batches(df.sparkSession)
    own = df.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{vector}`").alias("v"))
    single = dict(df.dtypes)[vector] == "array<float>"
    bits, tables = layout(df.count(), threshold, recall)
    size = -(-max(LEAST_BITS, bits * tables) // 64) * 64
    one = own.where("id is not null").groupBy("id").agg(F.min("v").alias("v"))
    coded = stored(one.mapInArrow(lambda batches: signed(batches, size, single), "id long, v binary, signs binary"), "signs")
    vectors = coded.where("v is not null").select("id", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"), "signs")
    classes = stored(vectors.groupBy("h1", "h2").agg(F.min("id").alias("class"), F.count("*").alias("size"), F.first("signs").alias("signs")), "classes")

    each = classes.select(F.col("class").alias("id"), "signs").mapInArrow(lambda batches: codes(batches, bits, tables), "id long, signs binary, codes array<int>")
    each = each.select("id", "signs", F.posexplode("codes").alias("t", "code"))
    large = each.groupBy("t", "code").count().where(F.col("count") > block)
    large = stored(large.select("t", "code", F.ceil(F.col("count") / block).cast("int").alias("k")), "large")  # broadcast only where its size allows
    chunk = F.coalesce(F.pmod(F.xxhash64("id"), F.col("k")), F.lit(0)).cast("int")
    keys = ["t", "code", "i", "j"]
    met = (
        each.join(large, ["t", "code"], "left").withColumn("c", chunk)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("k") - 1, F.lit(0)))))
        .select("t", "code", F.least("c", "other").alias("i"), F.greatest("c", "other").alias("j"), "c", "id", "signs")
    )
    rows = classes.count()
    apart = most_apart(size, threshold)
    near = dealt(met, keys, rows=rows * tables).mapInArrow(lambda batches: runs(batches, keys, lambda t: searched(t, bits, apart)), "t int, code int, i int, j int, c int, id long")
    near = stored(near, "candidates")
    shipped = stored(among(coded.select("id", "v", "signs"), stored(near.select("id").distinct(), "ids"), "id"), "vectors")
    sized = shipped.join(classes.select(F.col("class").alias("id"), "size"), "id")
    found = dealt(near.join(sized, "id"), keys, rows=near.count(), each=50_000)
    found = stored(found.mapInArrow(lambda batches: runs(batches, keys, lambda t: compared(t, bits, threshold, single)), "id long, n long, least long"), "links")
    discard(shipped)
    links = found.groupBy("id").agg(F.sum("n").alias("n"))
    nodes = components(found, "id", "least").withColumnRenamed("node", "id")
    of_class = classes.select("h1", "h2", F.col("class").alias("id"), "size").join(links, "id", "left").join(nodes, "id", "left").select(
        "h1", "h2", (F.col("size") - 1 + F.coalesce("n", F.lit(0))).cast("long").alias("n"), F.coalesce("component", "id").alias("component")
    )
    known = vectors.select("id", "h1", "h2").join(of_class, ["h1", "h2"]).select("id", "n", "component")
    rest = coded.where("v is null").select("id", F.lit(0).cast("long").alias("n"), F.col("id").alias("component"))
    nameless = own.where("id is null").select("id", F.lit(0).cast("long").alias("n"), F.col("id").alias("component"))
    every = known.unionByName(rest).unionByName(nameless)
    return every.select(F.col("id").alias("vec_id"), F.col("n").alias("n_links"), F.col("component").alias("component_id"), F.coalesce(F.col("component") == F.col("id"), F.lit(True)).alias("kept"))


@lean
def signed(batches: Iterator[pa.RecordBatch], size: int, single: bool) -> Iterator[pa.RecordBatch]:
    """Vectors as bytes, in their own precision, with the packed signs of their products with the hyperplanes; null for those that can't link."""
    planes: dict[int, np.ndarray] = {}
    for whole in batches:
        for from_ in range(0, whole.num_rows, 8 * ROWS_AT_ONCE):
            b = whole.slice(from_, 8 * ROWS_AT_ONCE)
            lists = b["v"]
            length = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            raw: list = [None] * len(lists)
            signs: list = [None] * len(lists)
            for dim in np.unique(length[length > 0]):
                at = np.flatnonzero(length == dim)
                x = lists.take(pa.array(at)).flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(-1, dim)
                top = np.abs(x).max(1)
                fine = np.isfinite(top) & (top > 0)
                x, at = x[fine], at[fine]
                if dim not in planes:
                    planes[dim] = np.random.default_rng([SEED, dim]).standard_normal((dim, size))
                packed = np.packbits((unit(x) @ planes[dim]) > 0, axis=1)
                for k, v, s in zip(at.tolist(), x.astype(np.float32 if single else np.float64), packed, strict=True):
                    raw[k], signs[k] = v.tobytes(), s.tobytes()
            yield pa.RecordBatch.from_arrays([b["id"], pa.array(raw, pa.binary()), pa.array(signs, pa.binary())], ["id", "v", "signs"])


def matrix(column) -> np.ndarray:
    """A row of bytes for each value; all values have the same length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def table_codes(signs: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """The code of each row in each of the first tables."""
    own = np.unpackbits(signs, axis=1, count=bits * tables).reshape(-1, tables, bits)
    return (own @ (1 << np.arange(bits, dtype=np.int64))).astype(np.int32)


@lean
def codes(batches: Iterator[pa.RecordBatch], bits: int, tables: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            flat = table_codes(matrix(b["signs"]), bits, tables)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * tables), pa.array(flat.reshape(-1)))
            yield pa.RecordBatch.from_arrays([b["id"], b["signs"], lists], ["id", "signs", "codes"])


def unit(x: np.ndarray) -> np.ndarray:
    """Vectors of length 1 in double precision."""
    x = x / np.abs(x).max(1)[:, None]
    return x / np.sqrt((x * x).sum(1))[:, None]


def first_met(signs: np.ndarray, t: int, bits: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the codes of rows a and b agree in no table before t."""
    if not t:
        return np.ones(len(a), bool)
    before = table_codes(signs, bits, t)
    return np.concatenate([~(before[a[s : s + 50_000]] == before[b[s : s + 50_000]]).any(1) for s in range(0, len(a), 50_000)] or [np.zeros(0, bool)])


def searched(table: pa.Table, bits: int, apart: int) -> Iterator[pa.RecordBatch]:
    """The rows with a candidate, from whole buckets or two chunks of one."""
    t, code, i, j, c = (table[x].to_numpy() for x in ("t", "code", "i", "j", "c"))
    signs = matrix(table["signs"])
    longs = np.ascontiguousarray(signs).view(np.uint64)
    cuts = bounds(t, code, i, j)
    keep = np.zeros(len(t), bool)
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        own, chunk = longs[lo:hi], c[lo:hi]
        for at in range(0, hi - lo - 1, ROWS_AT_ONCE):
            rows = own[at : at + ROWS_AT_ONCE]
            far = np.zeros((len(rows), hi - lo - at), np.uint16)
            for word in range(own.shape[1]):
                far += np.bitwise_count(rows[:, word, None] ^ own[None, at:, word])
            near = np.triu(far <= apart, 1)
            if i[lo] != j[lo]:
                near &= chunk[at : at + ROWS_AT_ONCE, None] != chunk[None, at:]
            a, b = np.nonzero(near)
            if len(a):
                new = first_met(signs[lo + at : hi], int(t[lo]), bits, a, b)
                keep[lo + at + a[new]] = keep[lo + at + b[new]] = True
    yield table.select(["t", "code", "i", "j", "c", "id"]).filter(pa.array(keep)).combine_chunks().to_batches()[0] if keep.any() else pa.RecordBatch.from_pylist([], table.select(["t", "code", "i", "j", "c", "id"]).schema)


def compared(table: pa.Table, bits: int, threshold: float, single: bool) -> Iterator[pa.RecordBatch]:
    """Links within whole buckets or between two chunks of one."""
    t, code, i, j, c, ids, weight = (table[x].to_numpy() for x in ("t", "code", "i", "j", "c", "id", "size"))
    vectors, signs = table["v"].combine_chunks(), matrix(table["signs"])
    out: list[list[np.ndarray]] = [[], [], []]
    cuts = bounds(t, code, i, j)
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        raw = vectors.slice(lo, hi - lo).to_pylist()
        for width in {len(r) for r in raw}:  # codes of vectors of different lengths may be the same
            at = lo + np.flatnonzero([len(r) == width for r in raw])
            if len(at) < 2:
                continue
            x = unit(np.frombuffer(b"".join(raw[k - lo] for k in at), np.float32 if single else np.float64).reshape(len(at), -1).astype(np.float64))
            near = np.triu(x @ x.T >= threshold, 1)
            if i[lo] != j[lo]:
                near &= c[at][:, None] != c[at][None, :]
            a, b = np.nonzero(near)
            new = first_met(signs[at], int(t[lo]), bits, a, b)
            a, b = a[new], b[new]
            if not len(a):
                continue
            own, w = ids[at], weight[at]
            n = np.bincount(a, w[b], len(at)) + np.bincount(b, w[a], len(at))
            some = n > 0
            for o, v in zip(out, (own[some], n[some], lowest(own, a, b)[some]), strict=True):
                o.append(v)
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*o, np.zeros(0, np.int64)]).astype(np.int64)) for o in out], ["id", "n", "least"])


def lowest(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least id that links reach from each."""
    low = ids.copy()
    while True:
        after = low.copy()
        np.minimum.at(after, a, low[b])
        np.minimum.at(after, b, low[a])
        if (after == low).all():
            return low
        low = after
