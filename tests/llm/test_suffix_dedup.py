import random
from collections import defaultdict

import pytest

from textloom.llm import suffix_dedup as S


def brute(rows, n):
    grams = defaultdict(set)
    for i, t in rows:
        w = (t or "").split()
        for k in range(len(w) - n + 1):
            grams[tuple(w[k : k + n])].add(i)
    out = []
    for i, t in rows:
        w = (t or "").split()
        hit = set()
        for k in range(len(w) - n + 1):
            if i is not None and grams[tuple(w[k : k + n])] - {i, None}:
                hit.update(range(k, k + n))
        out.append((i, len(w), sorted(hit)))
    return out


@pytest.mark.parametrize("chunk", [20_000, 7])
def test_against_brute_force(spark, chunk):
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(3000)}"
    text = lambda n: [word() for _ in range(n)]
    stock = [text(n) for n in (49, 50, 51, 60, 130, 400)]
    rows = []
    for i in range(80):
        w = text(rng.choice([0, 20, 200]))
        for _ in range(rng.choice([0, 1, 3])):
            p = rng.choice(stock)
            p = p[rng.choice([0, 0, 5]) : len(p) - rng.choice([0, 0, 7])]
            w = w + p + text(rng.choice([0, 1, 70]))
        rows.append((i, " ".join(w)))
    rows += [(200, None), (201, ""), (202, rows[3][1]), (3, rows[3][1]), (203, " ".join(["a"] * 200)), (None, rows[5][1]), (5, "changed " + rows[5][1])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, mark int").repartition(6)
    got = S.repeated_spans(df, chunk=chunk).collect()
    have = sorted(((r.doc_id, r.n_words, [k for s in r.spans for k in range(s.start, s.end)]) for r in got), key=str)
    assert have == sorted(brute(rows, 50), key=str)
    assert all(r.n_repeated == sum(s.end - s.start for s in r.spans) for r in got)


def least_hashed(text):
    """16 words that hold the least hash wherever they stand, so that no other suffix near them is kept."""
    import pyarrow as pa

    some = [text(S.GRAM) for _ in range(5000)]
    h, _, _ = S.windows(S.words(pa.array([" ".join(x) for x in some], pa.large_string())), S.GRAM)
    return some[int(h.argmin())]


def test_rare_contexts_of_a_frequent_passage(spark):
    """31 words that only two documents share, then 19 of a passage that all have, then words of their own: far apart in the order of the words to the right."""
    rng = random.Random(5)
    text = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    frequent, rows = least_hashed(text) + text(3), []
    for k in range(300):
        before = text(31)
        rows += [(2 * k + i, " ".join(before + frequent + text(60))) for i in range(2)]
    got = S.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), chunk=64).collect()
    have = sorted((r.doc_id, r.n_words, [k for s in r.spans for k in range(s.start, s.end)]) for r in got)
    assert sum(r.n_repeated > 0 for r in got) == len(rows)
    assert have == sorted(brute(rows, 50))


@pytest.mark.parametrize("chunk", [32, 5000])
def test_neighbours_across_chunks_of_a_large_group(spark, chunk):
    """Pairs that lie side by side in the order, in a group read in many batches: both documents have the span, wherever a chunk ends."""
    rng = random.Random(6)
    text = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    frequent, rows = least_hashed(text), []
    for k in range(300):
        before, after = text(31), text(3)
        rows += [(2 * k + i, " ".join(before + frequent + after + text(30))) for i in range(2)]
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, "33")
    try:
        got = S.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), chunk=chunk).collect()
    finally:
        spark.conf.unset(key)
    have = sorted((r.doc_id, r.n_words, [k for s in r.spans for k in range(s.start, s.end)]) for r in got)
    assert sum(r.n_repeated > 0 for r in got) == len(rows)
    assert have == sorted(brute(rows, 50))


@pytest.mark.parametrize("holders", [0, 5000, 50_000])
def test_passages_differ_to_the_left_of_a_common_one(spark, holders):
    """20 words that two documents share, then 30 that many hold: all found, with any number of partitions."""
    rng = random.Random(15)
    text = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    common, rows = text(30), []
    for k in range(20):
        before = text(20)
        rows += [(2 * k + i, " ".join(text(15) + before + common + text(25))) for i in range(2)]
    rows += [(100 + k, " ".join(text(15) + common + text(15))) for k in range(holders)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8).cache()
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    want = sorted(brute(rows, 50))
    try:
        for n in (1, 8, 64):
            spark.conf.set(key, str(n))
            got = sorted((r.doc_id, r.n_words, [k for s in r.spans for k in range(s.start, s.end)]) for r in S.repeated_spans(df).collect())
            assert sum(bool(x[2]) for x in got) == 40 and got == want
    finally:
        spark.conf.set(key, before)


def test_keys_of_two_documents_in_a_stream():
    """Runs of one key over batches of any size: rows come once the key has a second document, whatever came before."""
    import pyarrow as pa

    rng = random.Random(3)
    rows = sorted((rng.randrange(40) if k % 3 else 7, rng.randrange(9) if k % 5 else 1, k) for k in range(400)) + [(90, 5, 400 + k) for k in range(30)] + [(91, 1, 500), (91, 2, 501)]
    of_key = defaultdict(set)
    for key, i, _ in rows:
        of_key[key].add(i)
    want = sorted(k for key, _, k in rows if len(of_key[key]) > 1)
    for size in (1, 2, 7, 50, 1000):
        batches = [pa.RecordBatch.from_pydict({"key": pa.array([r[0] for r in b], pa.int64()), "id": pa.array([r[1] for r in b], pa.int64()), "mark": pa.array([r[2] for r in b], pa.int64()), **{c: pa.array([0] * len(b), pa.int32()) for c in ("pos", "start", "end")}}) for at in range(0, len(rows), size) if (b := rows[at : at + size])]
        got = [r for b in S.in_two(iter(batches)) for r in b.to_pylist()]
        key_of = {k: key for key, _, k in rows}
        assert sorted(r["mark"] for r in got) == want
        assert all(r["other"] != r["id"] and r["other"] in of_key[key_of[r["mark"]]] for r in got)


def test_nothing(spark):
    assert S.repeated_spans(spark.createDataFrame([], "doc_id long, text string")).count() == 0
