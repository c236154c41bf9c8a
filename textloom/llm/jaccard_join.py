"""Operator 2: similarity self-join of documents on their word shingles, by chosen paths.

A document is its set of runs of five words (of fewer, if it has fewer). Documents with the same set are one class, which takes part once.

Paths. The set of a class is embedded as ``COORDINATES`` min-hash tokens, of which similar sets share about the fraction of their
similarity. A node of the search holds some classes; it samples coordinates, each with probability 1 / (threshold * COORDINATES), and its
children hold the classes with the same token there. So two classes at the threshold share a child once on average, as long as they
shared the node. Nodes of at most ``BUCKET`` classes are leaves, larger ones split again; at the last level all are leaves, large ones in pairs of
chunks. ``runs_needed`` independent runs reach the target recall for pairs at the threshold itself,
from the survival probability of the branching process at the depth in use. The first coordinates are drawn once for all pairs, so ``planned`` draws
on until those drawn reach it too; closer pairs are found more surely.

Leaves are searched by brute force, twice. First only a byte of each token and the list of a class's leaves meet: a pair is a candidate if it shares as many tokens
as a pair at the threshold does (but four standard deviations, which are wide for small sets), and only in the least leaf that holds both, so no pair comes up
twice. Then only the classes with a candidate in a leaf go there again, with their texts, and those pairs are compared on their whole sets, exactly. A
block holds a bounded number of shingles, and its task emits a row for each class (number of linked documents, least linked id), not pairs. So the work
is that of the leaves, however far chains of links reach.

Edge cases: documents without a word link with nothing, nor do rows without an id, which come back one by one; rows that repeat an id are one document
(with the least digest of their sets); an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import among, bounded_batches, bounds, dealt, lean, runs, stored
from textloom.llm.components import components
from textloom.llm.embedding_dedup import lowest
from textloom.llm.token_counts import slices
from textloom.llm.words import Words, mix, windows, words

WORDS = 5
COORDINATES = 128
BUCKET = 256
LEVELS = 3
RECALL = 0.999
SIGMAS = 4
BLOCK_SHINGLES = 200_000
SLICE_BYTES = 1 << 20
SEED = 77
_PROBES = np.random.default_rng(SEED).integers(0, COORDINATES, (COORDINATES, 1024), dtype=np.uint8)
_EDGES = (np.arange(COORDINATES, dtype=np.uint64) << np.uint64(64 - COORDINATES.bit_length() + 1))
_C = np.uint64(0xA0761D6478BD642F)


def survival(depth: int) -> float:
    """Probability that two sets at the threshold share a node at that depth: a branching process with one child on average."""
    p = 1.0
    for _ in range(depth):
        p = 1 - math.exp(-p)
    return p


def runs_needed(recall: float, depth: int) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - survival(depth)))


def missed(plan: list[tuple[int, list[int]]], threshold: float, levels: int) -> float:
    """Probability that a pair at the threshold shares no node at the last level, for the first coordinates in the plan. Runs that begin with the same one
    begin with the same token, so they fail together where it differs."""
    drawn = [c for _, chosen in plan for c in chosen]
    below = 1 - survival(levels - 1)
    return math.prod(1 - threshold * (1 - below ** drawn.count(c)) for c in set(drawn))


def planned(threshold: float, recall: float, levels: int) -> list[tuple[int, list[int]]]:
    """The runs, each with the coordinates it begins with: ``runs_needed`` at least, and as many as these coordinates need."""
    rng = np.random.default_rng(SEED)
    n_runs, plan = runs_needed(recall, levels), []
    while len(plan) < n_runs or missed(plan, threshold, levels) > 1 - recall:
        plan.append((len(plan), np.flatnonzero(rng.random(COORDINATES) < 1 / (threshold * COORDINATES)).tolist()))
    return plan


def shingle_sets(w: Words, size: int) -> Iterator[np.ndarray]:
    """The sorted set of shingle hashes of each text."""
    h, _, first = windows(w, size)
    count = np.diff(w.first)
    for i in range(len(count)):
        if count[i] >= size:
            own = np.sort(h[first[i] : first[i + 1]])
            keep = np.empty(len(own), bool)
            keep[0] = True
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            yield own[keep]
        elif count[i]:
            x = np.array([count[i]], np.uint64)
            for k in range(w.first[i], w.first[i + 1]):
                x = mix(x * _C + w.hash[k])
            yield x
        else:
            yield np.zeros(0, np.uint64)


def digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed numbers."""
    return int(s.sum(dtype=np.uint64).view(np.int64)), int(mix(s ^ _C).sum(dtype=np.uint64).view(np.int64))


def tokens(s: np.ndarray) -> bytes:
    """One min-hash token for each coordinate: the least hash that falls to it; an empty coordinate takes that of the first full one of
    its own sequence of others."""
    at = np.searchsorted(s, _EDGES)
    at[at == len(s)] = len(s) - 1
    value = s[at]
    full = (value >> np.uint64(64 - COORDINATES.bit_length() + 1)) == np.arange(COORDINATES, dtype=np.uint64)
    if not full.all():
        empty = np.flatnonzero(~full)
        tries = full[_PROBES[empty]]
        value[empty] = np.where(tries.any(1), value[_PROBES[empty, tries.argmax(1)]], s[0])
    return (mix(value) >> np.uint64(32)).astype("<u4").tobytes()


@lean
def sketched(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = pc.fill_null(b["text"].cast(pa.large_string()), "")
        for at, to in slices(pc.binary_length(texts).to_numpy(zero_copy_only=False), SLICE_BYTES):
            n, d1, d2, out, marks = [], [], [], [], []
            for s in shingle_sets(words(texts.slice(at, to - at)), size):
                one, two = digest(s)
                n.append(len(s))
                d1.append(one)
                d2.append(two)
                out.append(tokens(s) if len(s) else None)
                marks.append(out[-1][::4] if len(s) else None)
            numbers = [pa.array(c, pa.int64()) for c in (n, d1, d2)]
            yield pa.RecordBatch.from_arrays([b["id"].slice(at, to - at), *numbers, pa.array(out, pa.binary()), pa.array(marks, pa.binary())], ["id", "n", "d1", "d2", "tokens", "marks"])


def matrix(column, kind: str = "<u4") -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, COORDINATES)


def child(node: np.ndarray | int, coordinate: int, value: np.ndarray) -> np.ndarray:
    base = mix(np.asarray(node, np.int64).view(np.uint64).reshape(-1) * _C + np.uint64(coordinate + 1))
    return mix(base ^ (value.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))).view(np.int64)


@lean
def roots(batches: Iterator[pa.RecordBatch], plan: list[tuple[int, list[int]]]) -> Iterator[pa.RecordBatch]:
    """The first nodes of each class in all runs."""
    for b in batches:
        if b.num_rows:
            m = matrix(b["tokens"])
            for run, chosen in plan:
                for c in chosen:
                    yield pa.RecordBatch.from_arrays([pa.array(child(run, c, m[:, c])), b["id"], b["n"]], ["node", "id", "n"])


def sampled(node: int, threshold: float) -> list[int]:
    """The coordinates that a node splits on."""
    draw = np.random.default_rng([SEED, node & 0xFFFFFFFF, (node >> 32) & 0xFFFFFFFF]).random(COORDINATES)
    return np.flatnonzero(draw < 1 / (threshold * COORDINATES)).tolist()


@lean
def split(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """The children of the nodes that the rows are in."""
    known: dict[int, list[int]] = {}
    for b in batches:
        if not b.num_rows:
            continue
        m, nodes = matrix(b["tokens"]), b["node"].to_numpy()
        which, inverse = np.unique(nodes, return_inverse=True)
        order = np.argsort(inverse, kind="stable")
        ends = np.cumsum(np.bincount(inverse))
        at, value = [], []
        for k, node in enumerate(which.tolist()):
            if node not in known:
                if len(known) > 100_000:
                    known.clear()
                known[node] = sampled(node, threshold)
            own = order[ends[k - 1] if k else 0 : ends[k]]
            for c in known[node]:
                at.append(own)
                value.append(child(node, c, m[own, c]))
        if at:
            rows, value = np.concatenate(at), np.concatenate(value)
            for lo in range(0, len(rows), 4096):
                own = b.select(["id", "n", "tokens"]).take(pa.array(rows[lo : lo + 4096]))
                yield pa.RecordBatch.from_arrays([pa.array(value[lo : lo + 4096]), *own.columns], ["node", "id", "n", "tokens"])


def least_tokens(n: np.ndarray, threshold: float) -> np.ndarray:
    """How many tokens a set of n shingles shares at least with one at the threshold: fewer distinct shingles spread more."""
    spread = np.sqrt(threshold * (1 - threshold) / np.clip(n, 1, COORDINATES))
    return np.maximum(1, np.ceil(COORDINATES * (threshold - SIGMAS * spread))).astype(np.int64)


class Leaves:
    """The leaves of the rows of a table, as lists of numbers."""

    def __init__(self, column: pa.ChunkedArray) -> None:
        lists = column.combine_chunks()
        self.first = lists.offsets.to_numpy()
        self.node = lists.values.to_numpy()

    def met(self, rows: np.ndarray, node: int) -> np.ndarray:
        """Which two of the rows share a leaf below this one."""
        size = self.first[rows + 1] - self.first[rows]
        row = np.repeat(np.arange(len(rows)), size)
        own = self.node[np.repeat(self.first[rows] - np.cumsum(size) + size, size) + np.arange(size.sum())]
        row, own = row[own < node], own[own < node]
        _, column, n = np.unique(own, return_inverse=True, return_counts=True)
        row, column = row[n[column] > 1], column[n[column] > 1]
        _, column = np.unique(column, return_inverse=True)
        m = np.zeros((len(rows), int(column.max()) + 1 if len(column) else 1), np.float32)
        m[row, column] = 1
        return (m @ m.T) > 0


MET = ["node", "i", "j", "c", "id"]


def searched(table: pa.Table, threshold: float) -> Iterator[pa.RecordBatch]:
    """The rows with a candidate, from whole leaves or two chunks of one."""
    keys = [table[k].to_numpy() for k in ("node", "i", "j")]
    chunk, need, m, leaves = table["c"].to_numpy(), least_tokens(table["n"].to_numpy(), threshold), matrix(table["marks"], "u1"), Leaves(table["nodes"])
    keep = np.zeros(len(chunk), bool)
    cuts = bounds(*keys)
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        if hi - lo < 2:
            continue
        x, least = m[lo:hi], need[lo:hi]
        near = np.stack([(x == r).sum(1, dtype=np.uint8) >= np.minimum(least, k) for r, k in zip(x, least, strict=True)])
        near = np.triu(near, 1)
        if keys[1][lo] != keys[2][lo]:
            near &= chunk[lo:hi, None] != chunk[None, lo:hi]
        some = np.flatnonzero(near.any(0) | near.any(1))
        if len(some):
            near = near[np.ix_(some, some)] & ~leaves.met(lo + some, keys[0][lo])
            keep[lo + some] = near.any(0) | near.any(1)
    yield from table.select(MET).filter(pa.array(keep)).combine_chunks().to_batches()


def compared(table: pa.Table, threshold: float, size: int) -> Iterator[pa.RecordBatch]:
    """Exact comparison of whole sets within a leaf or between two chunks of one, of the pairs that have no leaf below it."""
    keys = [table[k].to_numpy() for k in ("node", "i", "j")]
    ids, chunk, weight, d1 = (table[k].to_numpy() for k in ("id", "c", "size", "d1"))
    texts, leaves = table["text"].combine_chunks().cast(pa.large_string()), Leaves(table["nodes"])
    out: list[list[np.ndarray]] = [[], [], []]
    cuts = bounds(*keys)
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        sets, at, seen = [], [], set()
        for a, b in slices(pc.binary_length(texts.slice(lo, hi - lo)).to_numpy(zero_copy_only=False), SLICE_BYTES):
            for k, s in enumerate(shingle_sets(words(texts.slice(lo + a, b - a)), size), lo + a):
                if ids[k] not in seen and digest(s)[0] == d1[k]:  # not a row that repeats an id
                    seen.add(ids[k])
                    sets.append(s)
                    at.append(k)
        if len(at) < 2:
            continue
        at = np.array(at)
        n = np.array([len(s) for s in sets])
        common = overlaps(sets)
        near = np.triu(common >= threshold * (n[:, None] + n[None, :] - common) - 1e-6, 1)
        if keys[1][lo] != keys[2][lo]:
            near &= chunk[at][:, None] != chunk[at][None, :]
        if not near.any():
            continue
        a, b = np.nonzero(near & ~leaves.met(at, keys[0][lo]))
        own, w = ids[at], weight[at]
        links = np.bincount(a, w[b], len(at)) + np.bincount(b, w[a], len(at))
        some = links > 0
        for o, v in zip(out, (own[some], links[some], lowest(own, a, b)[some]), strict=True):
            o.append(v)
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*o, np.zeros(0, np.int64)]).astype(np.int64)) for o in out], ["id", "n", "least"])


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections."""
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    new = np.concatenate(([True], flat[1:] != flat[:-1]))
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1  # shingles of one set are in no intersection
    row, column = row[shared], column[shared]
    out = np.zeros((len(sets), len(sets)), np.float64)
    if len(row):
        column = np.cumsum(np.concatenate(([0], column[1:] != column[:-1])))
        step = min(int(column[-1]) + 1, max(64, 4_000_000 // len(sets)))
        for a in range(0, int(column[-1]) + 1, step):
            lo, hi = np.searchsorted(column, [a, a + step])
            part = np.zeros((len(sets), step), np.float32)
            part[row[lo:hi], column[lo:hi] - a] = 1
            out += part @ part.T
    return out


def joined_documents(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.8, size: int = WORDS, recall: float = RECALL, bucket: int | None = None, levels: int | None = None) -> DataFrame:
    """doc_id, class_id (the least id with the same set), n_links (other documents linked directly), component_id (the least
    id that links reach) and kept (it is that one)."""
    bounded_batches(docs.sparkSession)
    bucket, levels = bucket or BUCKET, levels or LEVELS
    own = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    named = own.where("id is not null")
    rows = stored(named.mapInArrow(lambda b: sketched(b, size), "id long, n long, d1 long, d2 long, tokens binary, marks binary"), "sketches")
    ids = rows.groupBy("id").agg(F.min(F.struct("d1", "d2", "n")).alias("d")).select("id", "d.*")
    classes = stored(ids.where("n > 0").groupBy("d1", "d2", "n").agg(F.min("id").alias("class_id"), F.count("*").alias("size")), "classes")
    first = classes.select(F.col("class_id").alias("id"), F.col("d1").alias("own"), "size")
    sketches = stored(rows.join(first, "id").where("d1 = own").dropDuplicates(["id"]).select("id", "d1", "size", "n", "tokens", "marks"), "classes")

    leaves = chosen_paths(sketches.select("id", "n", "tokens"), threshold, recall, bucket, levels)
    held = leaves.groupBy("id").agg(F.sort_array(F.collect_set(F.struct("node", "k"))).alias("at"))
    held = stored(held.select("id", "at", F.transform("at", lambda x: x.node).alias("nodes")), "held")
    keys = ["node", "i", "j"]
    met = held.join(sketches.select("id", "n", "marks"), "id").select("id", "n", "marks", "nodes", F.inline("at"))
    met = dealt(in_blocks(met, ["node"], ["id", "n", "marks", "nodes"]), keys, rows=leaves.count(), each=100_000)
    near = stored(met.mapInArrow(lambda b: runs(b, keys, lambda t: searched(t, threshold), 5000), "node long, i int, j int, c int, id long"), "candidates")
    whole = stored(among(named, stored(near.select("id").distinct(), "ids"), "id"), "texts")
    facts = held.select("id", "nodes").join(sketches.select("id", "d1", "size"), "id")
    ready = dealt(near.join(facts, "id").join(whole, "id"), keys, rows=near.count(), each=20_000)
    found = stored(ready.mapInArrow(lambda b: runs(b, keys, lambda t: compared(t, threshold, size), 500), "id long, n long, least long"), "links")
    links = found.groupBy("id").agg(F.sum("n").alias("links"))
    parts = components(found, "id", "least").withColumnRenamed("node", "id")
    of_class = classes.select("d1", "d2", "n", "class_id", "size").join(links.withColumnRenamed("id", "class_id"), "class_id", "left").join(parts.withColumnRenamed("id", "class_id"), "class_id", "left")
    out = ids.join(of_class, ["d1", "d2", "n"], "left").select(
        F.col("id").alias("doc_id"),
        F.coalesce("class_id", "id").alias("class_id"),
        F.coalesce(F.col("size") - 1 + F.coalesce("links", F.lit(0)), F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "class_id", "id").alias("component_id"),
        (F.coalesce("component", "class_id", "id") == F.col("id")).alias("kept"),
    )
    none = F.col("id")
    return out.unionByName(own.where("id is null").select(none.alias("doc_id"), none.alias("class_id"), F.lit(0).cast("long").alias("n_links"), none.alias("component_id"), F.lit(True).alias("kept")))


def in_blocks(df: DataFrame, keys: list[str], others: list[str]) -> DataFrame:
    """Rows of groups cut into ``k`` chunks, once for each pair of chunks i <= j that theirs is in."""
    return (
        df.withColumn("c", F.when(F.col("k") > 1, F.pmod(F.xxhash64("id"), F.col("k"))).otherwise(0).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.greatest(F.col("k") - 1, F.lit(0)))))
        .select(*keys, F.least("c", "other").alias("i"), F.greatest("c", "other").alias("j"), "c", *others)
    )


def chosen_paths(sketches: DataFrame, threshold: float, recall: float, bucket: int, levels: int) -> DataFrame:
    """The leaves of the search: node, id of a class in it, k (number of chunks). Each class stands in a bounded number of them. ``sketches`` has id, n, tokens."""
    plan = planned(threshold, recall, levels)
    nodes = sketches.mapInArrow(lambda b: roots(b, plan), "node long, id long, n long")
    leaves: DataFrame | None = None
    for level in range(1, levels + 1):
        nodes = stored(nodes, "nodes")
        sizes = nodes.groupBy("node").agg(F.count("*").alias("classes"), F.sum("n").alias("shingles"), F.sum(F.xxhash64("id").cast("decimal(20,0)")).alias("mark")).where("classes > 1")
        sizes = stored(sizes, "sizes")
        last = level == levels
        k = F.greatest(F.ceil(F.col("classes") / bucket), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int").alias("k")
        ends = sizes if last else sizes.where(F.col("classes") <= bucket)
        ends = ends.groupBy("classes", "mark", k).agg(F.min("node").alias("node"))  # a leaf says the same as another with the same classes; nodes that split draw each on their own
        own = stored(nodes.join(ends.select("node", "k"), "node").select("node", "id", "k"), "leaves")
        leaves = own if leaves is None else leaves.unionByName(own)
        large = sizes.where(F.col("classes") > bucket).select("node")
        if last or large.isEmpty():
            return leaves
        inside = stored(nodes.join(large, "node"), "inside")
        if "tokens" not in nodes.columns:
            inside = inside.join(among(sketches.select("id", "tokens"), stored(inside.select("id").distinct(), "ids"), "id"), "id")
        nodes = inside.select("id", "n", "tokens", "node").mapInArrow(lambda b: split(b, threshold), "node long, id long, n long, tokens binary")
    return leaves
