"""Divergence of sources against plain loops; queries against SQL are in test_sql."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from textloom.llm import divergence as dv

SCHEMA = "doc_id long, text string, lang string, source string"


def brute(rows, least=3, top=200):
    term = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    groups, docs, counts = defaultdict(set), defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        groups[lang].add(source)
        found = term.findall(text.translate(lower))
        docs[lang].update(set(found))
        counts[lang, source].update(found)
        counts[lang, None].update(found)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        share = {}
        for s in [*sources, None]:
            n = sum(counts[lang, s][t] for t in kept)
            share[s] = {t: 1 + 10**9 * (counts[lang, s][t] + 1) // (n + len(kept)) for t in kept}
        f = lambda p, q: (p - q) * (p - q) // q
        for s in sources:
            pairs = [(sum(f(share[s][t], share[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(f(share[s][t], share[None][t]), t) for t in kept if counts[lang, s][t] and share[s][t] > share[None][t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i) for i, (value, item) in enumerate(found[:most], 1)]
    return sorted(out)


def got(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    return sorted(map(tuple, dv.divergence(df, **options).collect()))


def corpus(seed, n=120):
    rng = random.Random(seed)
    words = ["a", "ab", "abc", "abd", "b", "été", "éta", "日本", "日", "Zoo", "zoo", "x1y", "don't"]
    rows = []
    for i in range(n):
        source = rng.choice(["s0", "s0", "s0", "s1", "s2", None])
        own = words if source == "s0" else words[3:]
        rows.append((i, " ".join(rng.choice(own) for _ in range(rng.choice([0, 1, 5, 60]))), rng.choice(["en", "en", "de", None]), source))
    return rows


def test_values_are_those_of_loops(spark):
    rows = corpus(1)
    rows += [(None, None, "en", "quiet"), (7, "", "fr", "a"), (7, "", "fr", "b"), (7, "solo", "it", "only"), *[(9, "same same", "en", "s1")] * 4]
    assert got(spark, rows) == brute(rows)
    assert got(spark, rows, top=2) == brute(rows, top=2)


def test_empty_table(spark):
    assert got(spark, []) == []


def test_many_flushes_ranges_and_blocks(spark, monkeypatch):
    rows = corpus(2)
    want = brute(rows)
    monkeypatch.setattr(dv, "BLOCK", 1)  # each source is a block of its own, or shares one by its hash
    assert got(spark, rows) == want
    assert got(spark, rows, portion=64) == want  # texts in portions


def test_a_trie_holds_its_terms():
    rng = random.Random(4)
    terms = {bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 8))) for _ in range(400)}
    trie = dv.Trie()
    leaves = {t: trie.leaf(t) for t in sorted(terms, key=lambda _: rng.random())}
    assert [trie.leaf(t) for t in terms] == [leaves[t] for t in terms] and trie.size == len(terms)
    assert list(trie.walk()) == [(t, leaves[t]) for t in sorted(terms)]


def test_cut_tries_merge_whatever_the_cuts():
    import pyarrow as pa

    own = dv.Counters()
    names = [("en", "a"), ("de", "b")]
    for n in names:
        own.groups[n] = len(own.groups)
    terms = [b"a", b"ab", b"b", b"ba"]
    leaves = np.array([own.trie.leaf(t) for t in terms])
    own.empty = {0: 2, 1: 1}
    own.add(np.concatenate([leaves << dv.Counters.GROUPS, leaves << dv.Counters.GROUPS | 1]), np.arange(8) + 1, np.ones(8, np.int64))
    sent = own.sent([(b"de", b"ab"), (b"en", b"a"), (b"en", b"b")])
    tables = [pa.ipc.open_stream(x.as_buffer()).read_all().cast(dv.LEAF_TYPES).to_pylist() for x in sent["leaves"]]
    assert sent["range"].to_pylist() == [0, 1, 2, 3]
    assert [[(r["lang"], r["term"], r["n"]) for r in t] for t in tables] == [
        [("de", "", 0), ("de", "a", 5)], [("de", "ab", 6), ("de", "b", 7), ("de", "ba", 8), ("en", "", 0)], [("en", "a", 1), ("en", "ab", 2)], [("en", "b", 3), ("en", "ba", 4)],
    ]


@pytest.mark.parametrize("columns", ["extra", "odd"])
def test_other_columns_are_not_read(spark, columns):
    from pyspark.sql import functions as F

    rows = corpus(3, 40)
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("term", "n", "total", "p0", "blocks", "a.b") if columns == "extra" else ("value", "rank", "range"):
        df = df.withColumn(c, F.lit("x"))
    assert sorted(map(tuple, dv.divergence(df).collect())) == brute(rows)
