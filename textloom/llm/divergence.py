"""Operator 11: how the sources of a language differ in their use of terms.

Each task counts the terms of its texts in a radix trie over their UTF-8 bytes, with a counter at each leaf for every (language, source) that has the term: its
occurrences and its documents. A trie that has grown to ``MOST_COUNTERS`` counters is sent on and begun anew. Tries merge by prefix range: ranges of (language, term) with about
equally many leaves, from at most ``SAMPLED`` terms of about ``SAMPLED_TEXTS`` texts (which has no bearing on results), cut each trie into runs of leaves in byte order, and a range's
runs are added up by one task. A term that many texts or sources have is one leaf, with one counter a task and source.

Terms in fewer than ``least`` documents of their language go. Shares are whole numbers out of 10**9, and all arithmetic is exact.

*Terms*: what stands out in a group are its own leaves, ranked within ranges of terms first and then within the group.

*Pairs*: a sum over all kept terms for each two sources. A term that neither of two sources has adds the same value each time, and one that only one of them has adds a value that
depends on its count alone; so the sum is that of the kept terms as if neither had them, corrections for each count of one source and of the other (a
histogram of counts a source), and a correction for each term that both have. Those come from a traversal of the leaves in UTF-8 order, term by term: the sources of one term meet
as an array, and a task holds sums for ``BLOCK`` by ``BLOCK`` sources. Where a language has more sources, each block of sources meets each other block.
The result has a row for each two sources of a language by its definition; no other step makes pairs as rows.

Edge cases: null text, language and source are ''; repeated rows count as often as they occur; a group without terms has its pairs, and a language without kept terms
pairs of value 0; a text without terms only makes its group occur; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import bounded_batches, bounds, first_ranked, lean, parts, runs, stored
from textloom.llm.spans import BREAK, portions, spans

PORTION = 8 << 20
MOST_COUNTERS = 500_000
BLOCK = 512
SCALE = 1_000_000_000
EACH = 400_000
RANGE_BYTES = 16 << 20
SAMPLED_TEXTS = 2_000
SAMPLED = 20_000
MERGED_ROWS = 1_000_000

KINDS = np.full(256, BREAK, np.uint8)
KINDS[97:123] = KINDS[128:] = 0


class Trie:
    """A radix trie: a node is [bytes on the way to it, children by first byte or None, number of its leaf or -1]."""

    def __init__(self) -> None:
        self.root: list = [b"", None, -1]
        self.size = 0

    def leaf(self, term: bytes) -> int:
        """The leaf of a term; a new one gets the next number."""
        node, at = self.root, 0
        while at < len(term):
            if node[1] is None:
                node[1] = {}
            below = node[1].get(term[at])
            if below is None:
                below = node[1][term[at]] = [term[at:], None, -1]
                at = len(term)
            elif term.startswith(below[0], at):
                at += len(below[0])
            else:  # the way forks inside this edge
                way, k = below[0], 1
                while k < len(way) and at + k < len(term) and way[k] == term[at + k]:
                    k += 1
                fork = node[1][term[at]] = [way[:k], {way[k]: below}, -1]
                below[0] = way[k:]
                below, at = fork, at + k
            node = below
        if node[2] < 0:
            node[2] = self.size
            self.size += 1
        return node[2]

    def walk(self) -> Iterator[tuple[bytes, int]]:
        """Terms and leaves in byte order, which is that of their code points."""
        stack = [(b"", self.root)]
        while stack:
            above, node = stack.pop()
            term = above + node[0]
            if node[2] >= 0:
                yield term, node[2]
            if node[1]:
                stack += [(term, node[1][b]) for b in sorted(node[1], reverse=True)]


class Counters:
    """Leaf counters of a trie: for each (leaf, group) occurrences and documents."""

    GROUPS = 24  # bits

    def __init__(self) -> None:
        self.trie = Trie()
        self.groups: dict[tuple[str, str], int] = {}
        self.empty: dict[int, int] = {}  # documents of each group, terms or not
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.rows = 0

    def add(self, key: np.ndarray, n: np.ndarray, docs: np.ndarray) -> None:
        self.held.append((key, n, docs))
        self.rows += len(key)
        if self.rows > 2 * MOST_COUNTERS:
            self.settle()

    def settle(self) -> int:
        if len(self.held) > 1:
            self.held = [merged(*(np.concatenate(x) for x in zip(*self.held, strict=True)))]
            self.rows = len(self.held[0][0])
        return self.rows

    def sent(self, cuts: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
        """All counters in runs, one for each range that has some, in the order of languages and terms; begins anew."""
        self.settle()
        names, langs = list(self.groups), sorted({lang for lang, _ in self.groups}, key=str.encode)
        walked = [(b"", -1), *self.trie.walk()]
        place = np.zeros(self.trie.size + 1, np.int64)
        place[[leaf for _, leaf in walked]] = np.arange(len(walked))
        key, n, docs = self.held[0] if self.held else (np.zeros(0, np.int64),) * 3
        roots = np.array(list(self.empty), np.int64)
        term = np.concatenate([np.zeros(len(roots), np.int64), place[key >> self.GROUPS]])
        group = np.concatenate([roots, key & ((1 << self.GROUPS) - 1)])
        n = np.concatenate([np.zeros(len(roots), np.int64), n])
        docs = np.concatenate([np.array(list(self.empty.values()), np.int64), docs])
        rank = {x: i for i, x in enumerate(langs)}
        lang = np.array([rank[x] for x, _ in names], np.int64)[group]
        spelled = [x for x, _ in walked]
        at = np.zeros(len(term), np.int64)
        for x, i in rank.items():
            own = lang == i
            first = bisect_left(cuts, (x.encode(), b""))
            steps = [bisect_left(spelled, t) for c, t in cuts[first:] if c == x.encode()]
            at[own] = first + np.searchsorted(np.array(steps, np.int64), term[own], "right")
        order = np.lexsort((term, lang, at))
        at, term, group, n, docs = (x[order] for x in (at, term, group, n, docs))
        texts, of = pa.array(spelled, pa.binary()).cast(pa.string()), [pa.array([x[i] for x in names], pa.string()) for i in (0, 1)]
        ends = bounds(at)
        runs_of = []
        for a, b in pairwise(ends):
            own = [pa.DictionaryArray.from_arrays(pa.array(group[a:b], pa.int32()), x) for x in of]
            table = pa.table([own[0], texts.take(pa.array(term[a:b])), own[1], pa.array(n[a:b]), pa.array(docs[a:b])], LEAF_NAMES)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
                out.write_table(table)
            runs_of.append(sink.getvalue().to_pybytes())
        self.__init__()
        return pa.RecordBatch.from_arrays([pa.array(at[ends[:-1]], pa.int32()) if runs_of else pa.array([], pa.int32()), pa.array(runs_of, pa.binary())], ["range", "leaves"])


LEAF_NAMES = ["lang", "term", "source", "n", "docs"]
LEAF_TYPES = pa.schema([("lang", pa.string()), ("term", pa.string()), ("source", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def merged(key: np.ndarray, n: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.array(bounds(key)[:-1], np.int64)
    if not len(first):
        return key, n, docs
    return key[first], np.add.reduceat(n[order], first), np.add.reduceat(docs[order], first)


def range_cuts(df: DataFrame, ranges: int) -> list[tuple[bytes, bytes]]:
    """Languages and terms at which ranges begin, from a bounded sample."""
    rows = df.count()
    some = df.sample(min(1.0, SAMPLED_TEXTS / max(rows, 1)), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts, _, _ in portions(batches, 2, KINDS, PORTION):
            t = spans(texts, KINDS)
            lang = b[0].take(pa.array(t.doc))
            yield from pa.table([lang, t.strings().cast(pa.string())], ["lang", "term"]).group_by(["lang", "term"]).aggregate([]).combine_chunks().to_batches()

    found = some.mapInArrow(run, "lang string, term string").distinct()
    picked = found.orderBy(F.xxhash64("lang", "term")).limit(SAMPLED).collect()
    keys = sorted((r.lang.encode(), r.term.encode()) for r in picked)
    return sorted({keys[i * len(keys) // ranges] for i in range(1, ranges)}) if keys else []


def tries(df: DataFrame, cuts: list[tuple[bytes, bytes]], portion: int = PORTION) -> DataFrame:
    """The tries of each task, cut into ranges: range, leaves (an Arrow stream of lang, term, source, n, docs). The empty term counts all documents of a group."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Counters()
        open_text: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # of a text that comes in several portions
        for b, texts, _, last in portions(batches, 2, KINDS, portion):
            pairs = list(zip(b[0].to_pylist(), b[1].to_pylist(), strict=True))
            group = np.array([own.groups.setdefault(p, len(own.groups)) for p in pairs], np.int64)
            t = spans(texts, KINDS)
            table = t.strings().dictionary_encode()
            leaves = np.array([own.trie.leaf(x) for x in table.dictionary.to_pylist()], np.int64)
            code = table.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            each, n = np.unique(t.doc * (len(leaves) + 1) + code, return_counts=True)
            doc, code = each // (len(leaves) + 1), each % (len(leaves) + 1)
            key = leaves[code] << Counters.GROUPS | group[doc] if len(each) else each
            found = merged(key, n, np.ones(len(n), np.int64))
            if not last or open_text:
                open_text.append(found)
                if not last:
                    continue
                key, n, _ = merged(*(np.concatenate(x) for x in zip(*open_text, strict=True)))
                found, open_text = (key, n, np.ones(len(n), np.int64)), []
            for g, k in zip(*np.unique(group, return_counts=True), strict=True):
                own.empty[int(g)] = own.empty.get(int(g), 0) + int(k)
            own.add(*found)
            if (own.rows > MOST_COUNTERS and own.settle() > MOST_COUNTERS) or len(own.groups) >= 1 << 20:
                yield own.sent(cuts)
        if own.groups:
            yield own.sent(cuts)

    return df.mapInArrow(run, "range int, leaves binary")


FOUND = "lang string, term string, source string, n long, total long, leads boolean"


def merged_tries(cut: DataFrame, ranges: int, least: int) -> DataFrame:
    """The leaves of all tries added up, of terms with ``least`` documents or more: lang, term, source, n, total (of the language's sources) and leads (true in one row of
    each term). The empty term comes with each source."""
    keys = LEAF_NAMES[:3]

    def added(tables: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(tables).group_by(keys).aggregate([("n", "sum"), ("docs", "sum")]).rename_columns(LEAF_NAMES)

    def finished(tables: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        table = added(tables).sort_by([(k, "ascending") for k in keys]).combine_chunks()
        codes = [table[k].combine_chunks().dictionary_encode().indices.to_numpy() for k in keys[:2]]
        ends = np.array(bounds(*codes))
        first, size = ends[:-1], np.diff(ends)
        n = table["n"].to_numpy()
        root = np.repeat(pc.equal(table["term"], "").to_numpy()[first], size)
        kept = np.repeat(np.add.reduceat(table["docs"].to_numpy(), first) >= least, size) | root
        leads = np.zeros(len(n), bool)
        leads[first] = True
        total = np.repeat(np.add.reduceat(n, first), size)
        out = pa.table([*[table[k] for k in keys], table["n"], pa.array(total), pa.array(leads & ~root)], [*keys, "n", "total", "leads"]).filter(pa.array(kept))
        yield from out.combine_chunks().to_batches(max_chunksize=50_000)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, rows = -1, [], 0
        for b in batches:
            for k, leaves in zip(b[0].to_pylist(), b[1], strict=True):
                if k != at and held:
                    yield from finished(held)
                    held, rows = [], 0
                at = k
                held.append(pa.ipc.open_stream(leaves.as_buffer()).read_all().cast(LEAF_TYPES))
                rows += held[-1].num_rows
                if rows > MERGED_ROWS:
                    held = [added(held)]
                    rows = held[0].num_rows // 2  # as much more may come before the next time
        if held:
            yield from finished(held)

    return cut.repartition(ranges, "range").sortWithinPartitions("range").mapInArrow(run, FOUND)


def share(n: str, total: str) -> str:
    """1 + floor(10**9 * n / total), in decimals, as 10**9 * n may pass 64 bits."""
    return f"1 + (cast({SCALE} as decimal(10,0)) * cast(({n}) as decimal(19,0))) div cast(({total}) as decimal(19,0))"


def gap(p: str, q: str) -> str:
    """floor((p - q) ** 2 / q) for shares, which are at most 10**9 + 1."""
    return f"(({p} - {q}) * ({p} - {q})) div {q}"


def sized(df: DataFrame, most: int = 500_000) -> DataFrame:
    """A stored table, to be broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= most else df


def both_have(kept: DataFrame, rows: int) -> DataFrame:
    """lang, source, item and common: for each two sources with a common term, what its count in both adds over what its counts add for each alone.

    ``kept`` has lang, term, source, p, p0 (the share of a term that the source lacks) and blocks (of the language's sources)."""
    own = kept.withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int"))
    own = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    own = own.select("lang", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "term", "source", "block", "p", "p0")
    keys = ["lang", "lo", "hi", "term"]
    n = parts(rows, EACH, int(kept.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    schema = "lang string, source string, item string, common long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums()
        yield from runs(batches, keys, sums.add, most=100_000)
        yield from sums.sent()

    found = own.repartition(n, *keys).sortWithinPartitions(*keys).mapInArrow(run, schema)
    return found.groupBy("lang", "source", "item").agg(F.sum("common").alias("common"))


class Sums:
    """What common terms add for each two sources of one pair of blocks."""

    def __init__(self) -> None:
        self.key: tuple | None = None
        self.place: dict[str, int] = {}
        self.block: list[int] = []
        self.sums = np.zeros((64, 64), np.int64)

    def numbers(self, names: list[str], blocks: np.ndarray) -> np.ndarray:
        out = np.zeros(len(names), np.int64)
        for i, x in enumerate(names):
            out[i] = self.place.setdefault(x, len(self.place))
            if out[i] == len(self.block):
                self.block.append(int(blocks[i]))
        size = len(self.sums)
        while size < len(self.place):
            size *= 2
        if size > len(self.sums):
            more = np.zeros((size, size), np.int64)
            more[: len(self.sums), : len(self.sums)] = self.sums
            self.sums = more
        return out

    def add(self, table: pa.Table) -> Iterator[pa.RecordBatch]:
        """Leaves of whole terms, in order."""
        column = lambda c: table[c].combine_chunks()
        lang, term = column("lang").dictionary_encode().indices.to_numpy(), column("term").dictionary_encode().indices.to_numpy()
        lo, hi, block, p, p0 = (column(c).to_numpy() for c in ("lo", "hi", "block", "p", "p0"))
        source = column("source").dictionary_encode()
        for a, b in pairwise(bounds(lang, lo, hi)):
            key = (table["lang"][a].as_py(), int(lo[a]), int(hi[a]))
            if key != self.key:
                yield from self.sent()
                self.__init__()
                self.key = key
            codes = source.indices.to_numpy()[a:b]
            used, first, inverse = np.unique(codes, return_index=True, return_inverse=True)
            at = self.numbers(source.dictionary.take(pa.array(used)).to_pylist(), block[a:b][first])[inverse]
            cuts = np.array(bounds(term[a:b]))
            sizes = np.diff(cuts)
            for n in np.unique(sizes[sizes > 1]):
                begins = cuts[:-1][sizes == n]
                for few in np.array_split(begins, -(-len(begins) * int(n) ** 2 // 2_000_000)):
                    rows = few[:, None] + np.arange(n)
                    self.together(at[rows], p[a:b][rows], p0[a:b][rows])

    def together(self, at: np.ndarray, p: np.ndarray, p0: np.ndarray) -> None:
        """Terms of equally many sources: a row for each term, a column for each source that has it."""
        f = lambda x, y: (x - y) ** 2 // y
        pa_, pb, za, zb = p[:, :, None], p[:, None, :], p0[:, :, None], p0[:, None, :]
        np.add.at(self.sums, (at[:, :, None], at[:, None, :]), f(pa_, pb) - f(pa_, zb) - f(za, pb) + f(za, zb))

    def sent(self) -> Iterator[pa.RecordBatch]:
        n = len(self.place)
        if n:
            block = np.array(self.block)
            lo, hi = self.key[1:]
            mine = np.minimum(block[:, None], block[None, :]) == lo
            mine &= np.maximum(block[:, None], block[None, :]) == hi
            a, b = np.nonzero(mine & (self.sums[:n, :n] != 0))
            names = pa.array(list(self.place), pa.string())
            lang = pa.array([self.key[0]] * len(a), pa.string())
            sums = pa.array(self.sums[a, b])
            yield pa.RecordBatch.from_arrays([lang, names.take(pa.array(a)), names.take(pa.array(b)), sums], ["lang", "source", "item", "common"])


def divergence(
    df: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source", least: int = 3, top: int = 200, portion: int = PORTION
) -> DataFrame:
    """lang, source, part, item, value and rank (from 1, by falling value and rising item).

    Part ``pair`` has a row for each other source of the language, value is the sum of floor((p - q) ** 2 / q) over the kept terms, p the source's share of a term and q the
    other's. Part ``term`` has the first ``top`` terms of the source whose share p is over the language's share q, by the same measure. A share is 1 + floor(10**9 * (n + 1) /
    (N + V)) for n occurrences of the term among the N of all V kept terms; kept are terms in ``least`` documents of the language or more."""
    spark = df.sparkSession
    bounded_batches(spark)
    blank = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    own = df.select(blank(lang).alias("lang"), blank(source).alias("source"), blank(text).alias("text"))
    n_bytes = own.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    ranges = min(SAMPLED, parts(n_bytes, RANGE_BYTES, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    found = stored(merged_tries(tries(own, range_cuts(own, ranges), portion), ranges, least), "leaves")
    own_terms = found.where("term <> ''")
    langs = own_terms.where("leads").groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("all"))
    sums = own_terms.groupBy("lang", "source").agg(F.sum("n").alias("own"))
    groups = found.where("term = ''").select("lang", "source").join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", F.coalesce("own", F.lit(0)).alias("own"), F.coalesce("v", F.lit(0)).alias("v"), "all")
    blocks = F.ceil(F.count("*").over(Window.partitionBy("lang")) / F.lit(BLOCK)).cast("int")
    groups = stored(groups.withColumn("blocks", blocks).withColumn("p0", F.expr(f"case when v > 0 then {share('1', 'own + v')} end")), "groups")
    shares = own_terms.join(sized(groups), ["lang", "source"])
    shares = shares.select("lang", "term", "source", F.expr(share("n + 1", "own + v")).alias("p"), "p0", "blocks", F.expr(share("total + 1", "all + v")).alias("q"))
    kept = stored(shares, "kept")
    n_kept = kept.count()

    order = [F.desc("value"), F.asc("item")]
    over = kept.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(gap("p", "q")).alias("value"))
    first = first_ranked(over, ["lang", "source"], order, "item", top, n_kept)

    levels = groups.where("v > 0").select("lang", F.col("p0").alias("z")).distinct()
    alone = kept.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("m")).join(levels, "lang")
    wide = lambda x, y: f"sum(cast(m as decimal(18,0)) * cast({gap('p', 'z') if x else gap('z', 'p')} - {y} as decimal(20,0)))"
    alone = alone.groupBy("lang", "source", "z").agg(F.expr(wide(True, gap("p0", "z"))).alias("first"), F.expr(wide(False, gap("z", "p0"))).alias("second"))
    alone = stored(alone, "alone")
    a = groups.select("lang", "source", "v", F.col("p0").alias("za"))
    b = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("zb"))
    pairs = a.join(b, "lang").where("source <> item")
    pairs = pairs.join(alone.select("lang", "source", F.col("z").alias("zb"), "first"), ["lang", "source", "zb"], "left")
    pairs = pairs.join(alone.select("lang", F.col("source").alias("item"), F.col("z").alias("za"), "second"), ["lang", "item", "za"], "left")
    pairs = pairs.join(both_have(kept.drop("q"), n_kept), ["lang", "source", "item"], "left")
    none = "cast(0 as decimal(38,0))"
    total = f"cast(v as decimal(18,0)) * cast({gap('za', 'zb')} as decimal(19,0)) + coalesce(first, {none}) + coalesce(second, {none}) + coalesce(common, 0)"
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.expr(f"case when v = 0 then 0L else cast({total} as long) end").alias("value"))
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order)))
    return ranked.unionByName(first).select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))
