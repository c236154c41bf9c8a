"""Operator 13: frequent phrases and how tightly their words are bound, by vertical positional lists.

Within a task each phrase has the list of its positions. A list of phrases of k - 1 words is extended by a merge join with the postings of what begins one word further
on: a phrase of k words is kept where both of its parts of k - 1 words are frequent in the whole corpus, and no break lies between. The length of a phrase's list
is its frequency in the task, and frequencies are sums of lengths. Levels go one after another, from one word up:

1. Tasks send lengths as sorted arrays of hashes and counts, cut into buckets by the hash's first bits, with 32 bits more of each hash; a bucket adds them up and answers with its stretch of
   a bitmap of ``FILTER_BITS`` bits, in which frequent hashes are set. The bitmap is all that the driver and the tasks hold, whatever the size of the corpus.
2. The next level extends only lists of phrases in the bitmap. Phrases that share bits with a frequent one come along, so nothing is missed.

At last the phrases in the bitmaps are counted as texts, and then the words that the frequent ones are made of, so results are exact and hashes decide nothing. A position is a word's
place in a portion of the texts; phrases end at breaks, so they never cross texts. In a corpus with more frequent phrases than the bitmap tells apart, more of the others are counted
as texts; results stay the same.

Scores are exact: decimals of 38 digits hold 10**6 * a * a up to a = 5 * 10**15.

Edge cases: a null text has no words, a null language is ``und``, together with a language of that name; repeated rows count as often as they occur; texts longer than two portions
are cut between words, with the last words before a cut carried on; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import bounded_batches, first_ranked, lean, stored
from textloom.llm.spans import BLANK, BREAK, Spans, portions, spans
from textloom.llm.words import hashes, mix

PORTION = 3 << 20
FILTER_BITS = 27
BUCKET_BYTES = 16 << 20
MOST_HELD = 1_000_000
MOST_PHRASES = 400_000

KINDS = np.zeros(256, np.uint8)
KINDS[[0x20, 0x09]] = BLANK
KINDS[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = BREAK

_STEP = np.uint64(0x9E3779B97F4A7C15)


def lang_codes(langs: pa.Array) -> tuple[list[str], np.ndarray]:
    """The languages of a batch, and the number of each row's."""
    own = pc.fill_null(langs.cast(pa.large_string()), "und").dictionary_encode()
    return own.dictionary.to_pylist(), own.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def word_hashes(t: Spans, names: list[str], codes: np.ndarray) -> np.ndarray:
    """A hash of each word and its text's language."""
    raw = [x.encode() for x in names]
    ends = np.cumsum([len(x) for x in raw])
    of_lang = hashes(np.frombuffer(b"".join(raw), np.uint8), ends - [len(x) for x in raw], ends) if raw else np.zeros(0, np.uint64)
    return mix(hashes(t.data, t.start, t.end) + of_lang[codes[t.doc]] * _STEP)


def among(h: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    bits = (8 * len(bitmap)).bit_length() - 1
    at = h >> np.uint64(64 - bits)
    return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def extended(at: np.ndarray, h: np.ndarray, word: np.ndarray, linked: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Lists of phrases of ``size`` words from those of one word less: positions in order, and the phrase's hash at each. ``at`` are the positions of frequent
    phrases; one that goes on has another at the next position, whose last word is the new one."""
    meets = np.flatnonzero(at[1:] == at[:-1] + 1)
    if size == 2:  # longer phrases have looked at these links
        meets = meets[linked[at[meets]]]
    first = at[meets]
    return first, mix(h[meets] * _STEP + word[first + size - 1])


def lists(t: Spans, word: np.ndarray, size: int, filters: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the phrases of ``size`` words whose parts are in the filters."""
    at, h = np.arange(len(word)), word
    for k in range(1, size):
        own = among(h, filters[k - 1])
        at, h = extended(at[own], h[own], word, t.linked, k + 1)
    return at, h


def added_up(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes without repeats, and the sums of their counts."""
    order = np.argsort(h, kind="stable")
    h, n = h[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
    return h[first], np.add.reduceat(n, first) if len(first) else n


class Tally:
    """Counts of hashes, kept short."""

    def __init__(self) -> None:
        self.h, self.n, self.more = np.zeros(0, np.uint64), np.zeros(0, np.int64), []

    def add(self, h: np.ndarray, n: np.ndarray) -> None:
        self.more.append((h, n))
        if sum(len(x) for x, _ in self.more) > max(len(self.h), MOST_HELD):
            self.settle()

    def settle(self) -> int:
        if self.more:
            self.h, self.n = added_up(np.concatenate([self.h, *[x for x, _ in self.more]]), np.concatenate([self.n, *[x for _, x in self.more]]))
            self.more = []
        return len(self.h)


PARTIAL = "bucket int, once binary, h binary, n binary"


def in_buckets(h: np.ndarray, n: np.ndarray, bucket_bits: int) -> tuple[list[int], list[list[bytes]]]:
    """Sorted hashes and their counts by the first ``bucket_bits`` (1 to 31) bits: the buckets, and of each the next 32 bits of hashes that came once, of others, and their counts."""
    cuts = np.searchsorted(h >> np.uint64(64 - bucket_bits), np.arange((1 << bucket_bits) + 1, dtype=np.uint64))
    full = [i for i in range(1 << bucket_bits) if cuts[i] < cuts[i + 1]]
    near = (h << np.uint64(bucket_bits) >> np.uint64(32)).astype(np.uint32)
    columns: list[list[bytes]] = [[], [], []]
    for i in full:
        own, many = near[cuts[i] : cuts[i + 1]], n[cuts[i] : cuts[i + 1]] > 1
        for c, x in zip(columns, (own[~many], own[many], n[cuts[i] : cuts[i + 1]][many]), strict=True):
            c.append(x.tobytes())
    return full, columns


def lengths(df: DataFrame, size: int, filters: list, bucket_bits: int, portion: int) -> DataFrame:
    """The lengths of the lists of each task, in buckets."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, bitmaps = Tally(), [np.frombuffer(f.value, np.uint8) for f in filters]

        def sent() -> pa.RecordBatch:
            full, columns = in_buckets(own.h, own.n, bucket_bits)
            own.h, own.n = own.h[:0], own.n[:0]
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), *[pa.array(c, pa.binary()) for c in columns]], ["bucket", "once", "h", "n"])

        for b, texts, again, _ in portions(batches, 1, KINDS, portion, size - 1):
            names, codes = lang_codes(b[0])
            t = spans(texts, KINDS)
            at, h = lists(t, word_hashes(t, names, codes), size, bitmaps)
            own.add(*added_up(h[at + size > again], np.ones(int((at + size > again).sum()), np.int64)))
            if own.settle() > MOST_HELD:
                yield sent()
        if own.settle():
            yield sent()

    return df.mapInArrow(run, PARTIAL)


def frequent_bits(partial: DataFrame, least: int, bucket_bits: int, bits: int) -> bytes:
    """The bitmap of the hashes with ``least`` occurrences or more: a row for each bucket, ``2 ** bits / 8`` bytes together."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, own = -1, Tally()

        def stretch() -> pa.RecordBatch:
            own.settle()
            out = np.zeros(1 << (bits - bucket_bits), np.uint8)
            out[(own.h[own.n >= least] >> np.uint64(32 - bits + bucket_bits)).astype(np.int64)] = 1
            return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([np.packbits(out, bitorder="little").tobytes()], pa.binary())], ["bucket", "bits"])

        for b in batches:
            for k, once, h, n in zip(b[0].to_pylist(), b[1], b[2], b[3], strict=True):
                if k != bucket:
                    if bucket >= 0:
                        yield stretch()
                    bucket, own = k, Tally()
                own.add(np.frombuffer(once.as_buffer(), np.uint32).astype(np.uint64), np.ones(len(once.as_buffer()) // 4, np.int64))
                own.add(np.frombuffer(h.as_buffer(), np.uint32).astype(np.uint64), np.frombuffer(n.as_buffer(), np.int64))
        if bucket >= 0:
            yield stretch()

    tasks = min(1 << bucket_bits, 4 * int(partial.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = partial.repartition(max(1, tasks), "bucket").sortWithinPartitions("bucket").mapInArrow(run, "bucket int, bits binary").collect()
    each = (1 << bits) // 8 >> bucket_bits
    out = bytearray((1 << bits) // 8)
    for r in found:
        out[r.bucket * each : (r.bucket + 1) * each] = r.bits
    return bytes(out)


COUNTED = "lang string, size int, phrase string, n long"
PHRASE_KEYS = ["lang", "size", "phrase"]


def counted(df: DataFrame, filters: list, portion: int, least_size: int = 1) -> DataFrame:
    """lang, size, phrase and n: the phrases of each size from ``least_size`` on in the filters (the first is for single words), as texts; and for each language a row of size 0 with
    the number of its words, where single words are counted."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmaps, most = [np.frombuffer(f.value, np.uint8) for f in filters], len(filters)
        held: list[pa.RecordBatch] = []
        for b, texts, again, _ in portions(batches, 1, KINDS, portion, most - 1):
            names, codes = lang_codes(b[0])
            t = spans(texts, KINDS)
            word = word_hashes(t, names, codes)
            lang = codes[t.doc]
            total = np.bincount(lang[again:], minlength=len(names))
            if least_size == 1:
                held.append(batch(names, np.arange(len(names)), 0, pa.nulls(len(names), pa.string()), total))
            at, h = np.arange(len(word)), word
            texts_of = t.strings().dictionary_encode()
            code, table = texts_of.indices.to_numpy(zero_copy_only=False).astype(np.int64), texts_of.dictionary
            for k in range(1, most + 1):
                own = among(h, bitmaps[k - 1])
                at, h = at[own], h[own]
                if k >= least_size:
                    held.append(distinct(at[at + k > again], k, lang, code, table, names))
                if k < most:
                    at, h = extended(at, h, word, t.linked, k + 1)
            if sum(x.num_rows for x in held) > MOST_PHRASES:
                held = pa.Table.from_batches(held).group_by(PHRASE_KEYS).aggregate([("n", "sum")]).rename_columns([*PHRASE_KEYS, "n"]).combine_chunks().to_batches()
                if sum(x.num_rows for x in held) > MOST_PHRASES // 2:
                    yield from held
                    held = []
        yield from held

    def distinct(at: np.ndarray, k: int, lang: np.ndarray, code: np.ndarray, table: pa.Array, names: list[str]) -> pa.RecordBatch:
        """The phrases that begin at these positions, told apart by their words' numbers."""
        key = lang[at]
        for i in range(k):
            _, key = np.unique(key * (len(table) + 1) + code[at + i], return_inverse=True)
        _, first, n = np.unique(key, return_index=True, return_counts=True)
        at = at[first]
        words = [table.take(pa.array(code[at + i])).cast(pa.large_string()) for i in range(k)]
        phrase = words[0] if k == 1 else pc.binary_join_element_wise(*words, pa.scalar(" ", pa.large_string()))
        return batch(names, lang[at], k, phrase.cast(pa.string()), n)

    def batch(names: list[str], lang: np.ndarray, k: int, phrase: pa.Array, n: np.ndarray) -> pa.RecordBatch:
        own = pa.array(names, pa.string()).take(pa.array(lang))
        return pa.RecordBatch.from_arrays([own, pa.array(np.full(len(n), k, np.int32)), phrase, pa.array(n.astype(np.int64))], [*PHRASE_KEYS, "n"])

    return df.mapInArrow(run, COUNTED)


def frequent_phrases(
    df: DataFrame, *, text: str = "text", lang: str = "lang", least: int = 10, longest: int = 3, bits: int = FILTER_BITS, bucket_bits: int | None = None, portion: int = PORTION
) -> DataFrame:
    """lang, size, phrase and n of all phrases of 2 to ``longest`` words with ``least`` occurrences or more and of the words that they are made of (a few more words may come along),
    and of each language a row of size 0 with its number of words; stored tables."""
    spark = df.sparkSession
    bounded_batches(spark)
    own = df.select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").cast("string").alias("text"))
    if bucket_bits is None:
        n_bytes = own.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
        bucket_bits = min(20, max(6, (n_bytes // BUCKET_BYTES).bit_length()))
    filters = []
    for size in range(1, longest + 1):
        filters.append(spark.sparkContext.broadcast(frequent_bits(lengths(own, size, filters, bucket_bits, portion), least, bucket_bits, bits)))
    summed = lambda c: c.groupBy(*PHRASE_KEYS).agg(F.sum("n").alias("n"))
    out = stored(summed(counted(own, filters, portion, 2)).where(f"n >= {int(least)}"), "phrases")
    parts_of = out.select("lang", F.explode(F.split("phrase", " ")).alias("word")).distinct()
    words = spark.sparkContext.broadcast(frequent_bits(marked(parts_of, bucket_bits), 1, bucket_bits, bits))
    single = stored(summed(counted(own, [words], portion)).where(f"size = 0 or n >= {int(least)}"), "words")
    for f in (*filters, words):
        f.destroy()
    return out.unionByName(single)


def marked(words: DataFrame, bucket_bits: int) -> DataFrame:
    """Words (lang, word) as lists of length one, in the form of ``lengths``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, codes = lang_codes(b[0])
            h, n = added_up(word_hashes(spans(b[1].cast(pa.large_binary()), KINDS), names, codes), np.ones(b.num_rows, np.int64))
            full, columns = in_buckets(h, n, bucket_bits)
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), *[pa.array(c, pa.binary()) for c in columns]], ["bucket", "once", "h", "n"])

    return words.mapInArrow(run, PARTIAL)


def collocations(df: DataFrame, *, text: str = "text", lang: str = "lang", least: int = 10, longest: int = 3, top: int = 2000, share: int = 50, **sizes) -> DataFrame:
    """The ``top`` phrases of 2 to ``longest`` words of each language by score: lang, rank, phrase, a (occurrences), l and r (of the parts at the
    lowest-scoring cut), n (words of the language), score.

    A phrase inside a longer one that has ``share`` hundredths of its occurrences or more is left out.
    """
    found = frequent_phrases(df, text=text, lang=lang, least=least, longest=longest, **sizes)
    words = F.split("phrase", " ")
    spelled = found.where("size >= 2").select("lang", "size", "phrase", F.col("n").alias("a"), words.alias("w"))
    one = found.where("size >= 1").select("lang", "phrase", "n")
    joined = lambda at, n: F.array_join(F.slice("w", at, n), " ")
    cuts = spelled.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("first"), joined(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
    cuts = cuts.join(one.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l")), ["lang", "first"])
    cuts = cuts.join(one.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
    wide = lambda c: f"cast({c} as decimal(16,0))"
    score = F.expr(f"cast(cast(1000000 as decimal(7,0)) * ({wide('a')} * {wide('a')}) as decimal(38,0)) div ({wide('l')} * {wide('r')})")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    longer = spelled.where("size >= 3").withColumn("part", F.explode(F.sequence(F.lit(2), F.col("size") - 1)))
    longer = longer.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("part") + 1)))
    longer = longer.groupBy("lang", joined(F.col("at"), F.col("part")).alias("phrase")).agg(F.max("a").alias("held"))
    left = best.join(longer, ["lang", "phrase"], "left").where(f"held is null or 100 * held < {int(share)} * a")
    left = stored(left.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"), "scored")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    ranked = first_ranked(left, ["lang"], order, "phrase", top, left.count())
    totals = found.where("size = 0").select("lang", F.col("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
