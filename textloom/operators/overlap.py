"""Overlap scores of generated texts: BLEU (of rows and of a corpus), ROUGE-N, ROUGE-L and METEOR.

``overlap`` compares two arrays of words in one pass over Arrow batches: words get numbers, n-grams get numbers from those of the n-gram one word shorter and the next
word's, and the numbers of both sides meet as sorted arrays. So the work is that of sorting the words of a batch, and nothing is shuffled. The longest common subsequence keeps a
row of the usual table as the bits of one number. The scores are Column functions of the counts, and counts add up over a corpus.

Null texts have no words; scores of texts without words are 0.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.text import split_words

MOST = 4
COUNTS = "struct<p:long,r:long,matches:array<long>,common:long,aligned:long,runs:long>"

# Endings that the second stage of METEOR leaves out, and the weights of its score.
ENDINGS = r"(ing|edly|ed|es|s|ly)$"
ALPHA, BETA, GAMMA = 0.9, 3.0, 0.5


def stem(words: Column) -> Column:
    """Words without their last ending, where three letters or more are left."""
    return F.transform(words, lambda w: F.when(F.length(F.regexp_replace(w, ENDINGS, "")) >= 3, F.regexp_replace(w, ENDINGS, "")).otherwise(w))


def numbered(*sides: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each side (lists of words): the row of each word, and its number, the same for the same word."""
    flat = pa.concat_arrays([s.flatten().cast(pa.large_string()) for s in sides]).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    out, at = [], 0
    for s in sides:
        sizes = pc.fill_null(pc.list_value_length(s), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        out.append((np.repeat(np.arange(len(s)), sizes), flat[at : at + sizes.sum()]))
        at += int(sizes.sum())
    return out


def clipped(p: tuple[np.ndarray, np.ndarray], r: tuple[np.ndarray, np.ndarray], rows: int, most: int) -> np.ndarray:
    """Common n-grams of each row for n from 1 to ``most``, each as often as both sides have it."""
    out = np.zeros((most, rows), np.int64)
    row, word = (np.concatenate(x) for x in zip(p, r, strict=True))
    side = np.repeat([0, 1], [len(p[0]), len(r[0])])
    at, gram = np.arange(len(word)), word
    for n in range(1, most + 1):
        if n > 1:
            go = at + n - 1 < len(word)
            at, gram = at[go], gram[go]
            go = (row[at + n - 1] == row[at]) & (side[at + n - 1] == side[at])
            at, gram = at[go], gram[go]
            _, gram = np.unique(gram * (int(word.max(initial=0)) + 1) + word[at + n - 1], return_inverse=True)
        key = row[at] * (int(gram.max(initial=0)) + 1) + gram
        ours, n_ours = np.unique(key[side[at] == 0], return_counts=True)
        theirs, n_theirs = np.unique(key[side[at] == 1], return_counts=True)
        _, i, j = np.intersect1d(ours, theirs, assume_unique=True, return_indices=True)
        np.add.at(out[n - 1], ours[i] // (int(gram.max(initial=0)) + 1), np.minimum(n_ours[i], n_theirs[j]))
    return out


def common_length(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence. Bit j of the row tells that the table doesn't rise at place j."""
    if not len(a) or not len(b):
        return 0
    places: dict[int, int] = {}
    for j, w in enumerate(b.tolist()):
        places[w] = places.get(w, 0) | 1 << j
    every = (1 << len(b)) - 1
    row = every
    for w in a.tolist():
        hit = row & places.get(w, 0)
        if hit:
            row = (row + hit | row - hit) & every
    return len(b) - row.bit_count()


def paired(p: tuple[np.ndarray, np.ndarray], r: tuple[np.ndarray, np.ndarray], free_p: np.ndarray, free_r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of equal words, the k-th of one side with the k-th of the other, which crosses least among equal words: places in p and r."""
    keys, places = [], []
    scale = int(max(p[1].max(initial=0), r[1].max(initial=0))) + 1
    for (row, word), free in ((p, free_p), (r, free_r)):
        at = np.flatnonzero(free)
        key = row[at] * scale + word[at]
        order = np.argsort(key, kind="stable")
        key, at = key[order], at[order]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        times = np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key))))
        keys.append(np.stack([key, times], 1))
        places.append(at)
    both = np.concatenate(keys)
    _, number = np.unique(both, axis=0, return_inverse=True) if len(both) else (None, np.zeros(0, np.int64))
    number = number.reshape(-1)
    _, i, j = np.intersect1d(number[: len(keys[0])], number[len(keys[0]) :], assume_unique=True, return_indices=True)
    return places[0][i], places[1][j]


def aligned_runs(p, r, stems_p, stems_r, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Aligned words of each row, equal ones first and then those with equal stems, and the runs in which they follow each other on both sides."""
    free_p, free_r = np.ones(len(p[0]), bool), np.ones(len(r[0]), bool)
    ours, theirs = [], []
    for a, b in ((p, r), (stems_p, stems_r)):
        i, j = paired(a, b, free_p, free_r)
        free_p[i] = free_r[j] = False
        ours.append(i)
        theirs.append(j)
    i, j = np.concatenate(ours), np.concatenate(theirs)
    order = np.argsort(i)
    i, j = i[order], j[order]
    row = p[0][i]
    new = np.ones(len(i), bool)
    new[1:] = (row[1:] != row[:-1]) | (i[1:] != i[:-1] + 1) | (j[1:] != j[:-1] + 1)
    return np.bincount(row, minlength=rows), np.bincount(row[new], minlength=rows)


def counter(most: int, common: bool, align: bool) -> Callable:
    def counts(p: pa.Array, r: pa.Array, ps: pa.Array, rs: pa.Array) -> pa.Array:
        rows = len(p)
        sides = numbered(p, r)
        matches = clipped(*sides, rows, most)
        length = np.zeros(rows, np.int64)
        if common:
            ends = [np.searchsorted(s[0], np.arange(rows + 1)) for s in sides]
            for i in range(rows):
                length[i] = common_length(*(s[1][e[i] : e[i + 1]] for s, e in zip(sides, ends, strict=True)))
        n, runs = aligned_runs(*sides, *numbered(ps, rs), rows) if align else (np.zeros(rows, np.int64),) * 2
        each = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * most), pa.array(matches.T.reshape(-1)))
        sizes = [pa.array(np.bincount(s[0], minlength=rows).astype(np.int64)) for s in sides]
        return pa.StructArray.from_arrays([*sizes, each, pa.array(length), pa.array(n.astype(np.int64)), pa.array(runs.astype(np.int64))], ["p", "r", "matches", "common", "aligned", "runs"])

    counts.__annotations__ = {"p": pa.Array, "r": pa.Array, "ps": pa.Array, "rs": pa.Array, "return": pa.Array}
    return counts


def overlap(prediction: Column, reference: Column, most: int = MOST, lower: bool = False, common: bool = False, align: bool = False) -> Column:
    """Words of both texts (p, r) and matches of n-grams up to ``most``; with ``common`` the longest common subsequence, with ``align`` METEOR's alignment
    (aligned words, runs)."""
    p, r = (split_words(F.coalesce(F.lower(c) if lower else c, F.lit(""))) for c in (prediction, reference))
    none = F.array().cast("array<string>")
    return F.arrow_udf(counter(most, common, align), COUNTS)(p, r, stem(p) if align else none, stem(r) if align else none)


def f1(common: Column, n_a: Column, n_b: Column) -> Column:
    return F.when(common > 0, 2 * common / (n_a + n_b)).otherwise(F.lit(0.0))


def rouge_n(o: Column, n: int = 1) -> Column:
    grams = lambda c: F.greatest(c - (n - 1), F.lit(0))
    return f1(F.get(o.matches, n - 1), grams(o.p), grams(o.r))


def rouge_l(o: Column) -> Column:
    return f1(o.common, o.p, o.r)


def bleu(o: Column, most: int = MOST) -> Column:
    """Geometric mean of clipped precisions, with the brevity penalty; 0 if a precision is 0. ``o`` may have the sums of many rows: ``bleu`` of a corpus."""
    precision = lambda n: F.when(F.get(o.matches, n - 1) > 0, F.get(o.matches, n - 1) / (o.p - (n - 1)))
    return bleu_of([precision(n) for n in range(1, most + 1)], o.p, o.r)


def bleu_of(precisions: list[Column], p: Column, r: Column) -> Column:
    mean = F.exp(sum((F.log(x) for x in precisions), F.lit(0.0)) / len(precisions))
    return F.coalesce(mean * F.when(p >= r, F.lit(1.0)).otherwise(F.exp(1 - r / p)), F.lit(0.0))


def corpus_bleu(counts: str, most: int = MOST) -> Column:
    """BLEU of all rows of a group together, from the sums of a column of counts: an aggregate."""
    o, total = F.col(counts), lambda c: F.sum(c)
    grams = lambda n: total(F.greatest(o.p - (n - 1), F.lit(0)))
    hits = [total(F.get(o.matches, n - 1)) for n in range(1, most + 1)]
    return bleu_of([F.when(h > 0, h / grams(n)) for n, h in enumerate(hits, 1)], total(o.p), total(o.r))


def meteor(o: Column) -> Column:
    """Weighted mean of precision and recall of aligned words, less for alignments in many runs."""
    p, r = o.aligned / o.p, o.aligned / o.r
    return F.when(o.aligned > 0, p * r / (ALPHA * p + (1 - ALPHA) * r) * (1 - GAMMA * F.pow(o.runs / o.aligned, F.lit(BETA)))).otherwise(F.lit(0.0))
