"""Vector best-fit against the library's ids and a plain loop."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from textloom.llm import best_fit as bf

FILE = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string"


def pieces_of(rows, size):
    from tokenizers import Tokenizer

    own, out = Tokenizer.from_file(FILE), []
    for doc, text in rows:
        ids = [*own.encode(text or "", add_special_tokens=False).ids, 0]
        for k, start in enumerate(range(0, len(ids), size)):
            cut = ids[start : start + size]
            out.append((doc, k, start, len(cut), zlib.crc32(np.array(cut, "<u4").tobytes())))
    return sorted(out, key=repr)


def corpus(seed, n):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice(["the", "Cat", "sat,", "été", "on1"]) for _ in range(rng.choice([0, 1, 3, 9, 14, 30, 90])))) for i in range(n)]


def sequences(rows):
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    return {k: sorted(v) for k, v in held.items()}


def check(rows, size, documents=None, attention=None):
    for own in sequences(rows).values():
        at = 0
        for offset, length in own:
            assert offset == at
            at += length
        assert at <= size and len(own) <= (documents or size) and sum(n * n for _, n in own) <= (attention or size * size)


def test_pieces_are_the_librarys(spark):
    rows = corpus(1, 200) + [(None, None), (5, "twice"), (5, "twice"), (6, ""), (7, "long " * 5000)]
    got = bf.fill(spark.createDataFrame(rows, SCHEMA).repartition(3), FILE, size=64, lot=20, kept=4).collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=repr) == pieces_of(rows, 64)
    check(got, 64)


def test_few_sequences(spark):
    rows = corpus(2, 600)
    df = spark.createDataFrame(rows, SCHEMA)
    for lot in (bf.LOT, 40):
        got = bf.fill(df, FILE, size=64, lot=lot).collect()
        check(got, 64)
        least = -(-sum(r.length for r in got) // 64)
        assert len(sequences(got)) <= 1.02 * least + 1


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_capacity_holds(spark, rule):
    rows = corpus(3, 300)
    got = bf.fill(spark.createDataFrame(rows, SCHEMA), FILE, size=64, documents=5, attention=64 * 64, rule=rule, weights=(1, 1, 1), lot=50).collect()
    check(got, 64, 5)
    assert len(got) == len(pieces_of(rows, 64))
    assert max(len(x) for x in sequences(got).values()) == 5  # the bound on documents binds


def test_attention_binds():
    room = np.array([100, 100, 5000])
    n = np.array([60, 40, 40, 30, 30, 10, 10], np.int64)
    bins, offset, left = bf.placed(n, room, np.ones(3), "norm")
    for b in range(bins.max() + 1):
        own = n[bins == b]
        assert (own * own).sum() <= 5000 and own.sum() <= 100 and left[b].tolist() == [100 - own.sum(), 100 - len(own), 5000 - (own * own).sum()]
        assert offset[bins == b].tolist() == (np.cumsum(own) - own).tolist()
    with pytest.raises(ValueError):
        bf.placed(np.array([90]), room, np.ones(3), "norm")


def test_the_best_bin_is_taken():
    """Each placement against a loop over all bins."""
    rng = np.random.default_rng(5)
    for rule in ("norm", "dot"):
        n = np.sort(rng.integers(1, 50, 200))[::-1].astype(np.int64)
        room, w = np.array([64, 6, 64 * 64]), np.array([1.0, 0.3, 0.2])
        bins, _, _ = bf.placed(n, room, w, rule)
        left = []
        for x, b in zip(n, bins, strict=True):
            d = np.array([x, 1, x * x])
            score = [(float(((r / room) @ (w * d / room)) if rule == "dot" else -((((r - d) / room) ** 2) @ w)) if (r >= d).all() else -np.inf) for r in left]
            if score and max(score) > -np.inf:
                assert score[b] >= max(score) - 1e-12
            else:
                assert b == len(left)
                left.append(room.copy())
            left[b] = left[b] - d


def test_empty_table_and_other_columns(spark):
    assert bf.fill(spark.createDataFrame([], SCHEMA), FILE).count() == 0
    df = spark.createDataFrame(corpus(4, 20), SCHEMA)
    for c in ("piece", "length", "lot", "number", "is_open", "a.b"):
        df = df.withColumn(c, F.lit("x"))
    got = bf.fill(df, FILE, size=64).collect()
    assert len(got) == len(pieces_of(corpus(4, 20), 64))
    with pytest.raises(ValueError):
        bf.fill(df, FILE, rule="first")
