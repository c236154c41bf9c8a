"""Overlap scores against plain loops."""

import random

import numpy as np
from pyspark.sql import functions as F

from textloom.operators import overlap


def of(**options):
    return overlap.overlap(F.col("p"), F.col("r"), **options).alias("o")


def loops(p, r, n):
    grams = lambda w: [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]
    a, b = grams(p), grams(r)
    return sum(min(a.count(g), b.count(g)) for g in set(a))


def subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        above, row = row, [0]
        for j, y in enumerate(b):
            row.append(above[j] + 1 if x == y else max(above[j + 1], row[-1]))
    return row[-1]


def test_counts_are_those_of_loops(spark):
    rng = random.Random(3)
    texts = [(i, *(" ".join(rng.choice("abcde") for _ in range(rng.choice([0, 1, 3, 12, 40]))) for _ in range(2))) for i in range(200)]
    texts += [(200, None, "a b"), (201, "a " * 3000, "b a " * 3000)]
    own = spark.createDataFrame(texts, "id int, p string, r string").repartition(3)
    got = {x.id: x.o for x in own.select("id", of(common=True)).collect()}
    for i, p, r in texts:
        p, r = (p or "").split(), (r or "").split()
        assert (got[i].p, got[i].r) == (len(p), len(r))
        if len(p) < 100:
            assert got[i].matches == [loops(p, r, n) for n in (1, 2, 3, 4)] and got[i].common == subsequence(p, r)
    assert got[201].matches == [3000, 0, 0, 0] and got[201].common == 3000


def test_scores(spark):
    rows = spark.createDataFrame([("the cat sat", "the cat ran"), ("", "a"), ("a b c d e", "a b c d e"), (None, None)], "p string, r string")
    o = rows.select(of(lower=True, common=True, align=True))
    c = F.col("o")
    got = o.select(overlap.rouge_n(c), overlap.rouge_n(c, 2), overlap.rouge_l(c), overlap.bleu(c), overlap.meteor(c)).collect()
    assert [round(x, 4) for x in got[0]] == [0.6667, 0.5, 0.6667, 0.0, round(2 / 3 * (1 - 0.5 / 8), 4)]
    assert list(got[1]) == [0.0] * 5 == list(got[3])
    assert [round(x, 6) for x in got[2]] == [1.0, 1.0, 1.0, 1.0, round(1 - 0.5 / 125, 6)]
    assert rows.limit(0).select(of()).count() == 0


def test_corpus_score_is_of_sums(spark):
    rows = spark.createDataFrame([("a b c d e f", "a b c d e g"), ("x y", "x z z")], "p string, r string")
    got = rows.select(of()).agg(overlap.corpus_bleu("o")).first()[0]
    assert abs(got - (6 / 8 * 4 / 6 * 3 / 4 * 2 / 3) ** 0.25 * np.exp(1 - 9 / 8)) < 1e-12


def test_stems_align_after_equal_words(spark):
    rows = spark.createDataFrame([("dogs walked home", "dog walking home home")], "p string, r string")
    o = rows.select(of(align=True)).first().o
    assert (o.aligned, o.runs) == (3, 1)
