"""Phrases against plain loops; queries against SQL are in test_sql."""

import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from textloom.llm import phrases as ph

SCHEMA = "doc_id long, text string, lang string"


def brute(rows, least=10, longest=3, top=2000, share=50):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f = {}
    for _, text, lang in rows:
        own = f.setdefault("und" if lang is None else lang, Counter())
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(lower)):
            w = re.findall("[^ \t]+", piece)
            for k in range(1, longest + 1):
                own.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, own in f.items():
        n = sum(c for w, c in own.items() if len(w) == 1)
        cand = {w: a for w, a in own.items() if len(w) > 1 and a >= least}
        held = Counter()
        for w, a in cand.items():
            for k in range(2, len(w)):
                for i in range(len(w) - k + 1):
                    held[w[i : i + k]] = max(held[w[i : i + k]], a)
        found = []
        for w, a in cand.items():
            if 100 * held[w] >= share * a:
                continue
            score, k = min((1000000 * a * a // (own[w[:k]] * own[w[k:]]), k) for k in range(1, len(w)))
            found.append((lang, " ".join(w), a, own[w[:k]], own[w[k:]], n, score))
        found.sort(key=lambda x: (-x[6], -x[2], x[1].encode()))
        out += [(x[0], i, *x[1:]) for i, x in enumerate(found[:top], 1)]
    return sorted(out)


def corpus(seed, n=150):
    rng = random.Random(seed)
    words = ["the", "The", "of", "new", "york", "city", "é x", "日本", "a" * 70, "b"]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.choice([0, 1, 8, 40])):
            parts += [rng.choice(["new york city", "the of", *words]), rng.choice([" ", " ", "\t ", ". ", ",", "\n"])]
        rows.append((i, "".join(parts), rng.choice(["en", "en", "de", None, "und"])))
    return rows


def got(spark, rows, **options):
    return sorted(map(tuple, ph.collocations(spark.createDataFrame(rows, SCHEMA).repartition(4), **options).collect()))


def test_rows_are_those_of_loops(spark):
    rows = corpus(1) + [(None, None, "fr"), (1, "", "fr"), *[(2, "so it goes. so it goes", "es")] * 5]
    assert got(spark, rows) == brute(rows)
    assert got(spark, rows, least=2, longest=4, top=7) == brute(rows, 2, 4, 7)


def test_overlapping_phrases_and_breaks(spark):
    rows = [(1, "a a a a a a a a a a a a", "en"), (2, "x y. z\nx y, z\x0bx y! z" + " ;x\ty z" * 9, "en")]
    assert got(spark, rows) == brute(rows)


def test_long_texts_come_in_portions(spark):
    rng = random.Random(2)
    text = " ".join(rng.choice(["p", "q", "r. ", "s"]) for _ in range(4000))
    rows = [(1, text, "en"), (2, "w" * 3000 + " v" * 500, "en"), (3, "p q r", "en")]
    assert got(spark, rows, portion=256) == brute(rows)


def test_a_full_bitmap_changes_nothing(spark):
    rows = corpus(3)
    assert got(spark, rows, bits=9, bucket_bits=3) == brute(rows)  # most hashes share a bit


def test_empty_table_and_other_columns(spark):
    assert got(spark, []) == []
    rows = corpus(4, 60)
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("phrase", "n", "a", "l", "r", "k", "salt", "a.b"):
        df = df.withColumn(c, F.lit(1))
    assert sorted(map(tuple, ph.collocations(df).collect())) == brute(rows)


def test_large_counts_stay_exact(spark):
    a, l, r = 10**15 + 7, 3 * 10**15 + 11, 2 * 10**15 + 13
    df = spark.createDataFrame([(a, l, r)], "a long, l long, r long")
    wide = lambda c: f"cast({c} as decimal(16,0))"
    got = df.select(F.expr(f"cast(cast(1000000 as decimal(7,0)) * ({wide('a')} * {wide('a')}) as decimal(38,0)) div ({wide('l')} * {wide('r')})").alias("s")).first().s
    assert got == 10**6 * a * a // (l * r)


def test_lists_are_extended_by_neighbours():
    word = np.arange(6, dtype=np.uint64)
    at, _ = ph.extended(np.array([0, 1, 3, 4, 5]), word[[0, 1, 3, 4, 5]], word, np.array([True, True, True, True, False, False]), 2)
    assert at.tolist() == [0, 3]  # 1 has no neighbour, a break parts 4 and 5
