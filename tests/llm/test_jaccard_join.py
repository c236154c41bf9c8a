import random
import re

from textloom.llm import jaccard_join as J

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def shingles(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    links = {i: {j for j in sets if j != i and sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])} for i in sets}
    out = {}
    for i in sets:
        seen, todo = {i}, [i]
        while todo:
            for k in links[todo.pop()] - seen:
                seen.add(k)
                todo.append(k)
        out[i] = (len(links[i]), min(seen), min(seen) == i)
    return out


def corpus():
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(500)] + ["ñu", "Éa", "X"]
    rows = []

    def add(words):
        rows.append((len(rows) * 37 % 1013, " ".join(words)))

    for k in range(60):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 12, 60, 400]))]
        add(base)
        for _ in range(60 if k == 0 else rng.randint(0, 4)):
            near = list(base)
            for _ in range(max(0, int(len(base) * rng.choice([0, 0.005, 0.015, 0.03, 0.08])))):
                near[rng.randrange(len(near))] = rng.choice(vocabulary)
            add(near)
    return [*rows, (2000, None), (2001, ""), (2002, "!!"), (2003, "!!"), (2004, "one Two three"), (2005, "ONE two, three")]


def test_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, 1) for r in [*rows, rows[4], (None, "a b c")]], "doc_id long, text string, n int").repartition(4)
    for bucket in (256, 8):
        got = {r.doc_id: (r.n_links, r.component_id, r.kept) for r in J.joined_documents(df, recall=0.9999, bucket=bucket).collect()}
        assert got.pop(None) == (0, None, True)
        assert got == brute(rows)


def test_tokens_agree_as_often_as_the_sets():
    import numpy as np

    rng = np.random.default_rng(1)
    for n in (1, 5, 40, 2000):
        both = rng.integers(0, 2**64, n, dtype=np.uint64)
        a = np.sort(np.concatenate((both, rng.integers(0, 2**64, n // 8, dtype=np.uint64))))
        b = np.sort(np.concatenate((both, rng.integers(0, 2**64, n // 8, dtype=np.uint64))))
        same = (np.frombuffer(J.tokens(a), "<u4") == np.frombuffer(J.tokens(b), "<u4")).mean()
        assert abs(same - n / (n + 2 * (n // 8))) < 0.15


def test_runs_follow_the_recall():
    assert J.runs_needed(0.99, 1) == 5 and J.runs_needed(0.99, 3) == 10


def sketches_of(spark, groups):
    """A table for ``chosen_paths`` of the tokens in each group; ids go on from group to group."""
    rows = [bytearray(t.astype("<u4").tobytes()) for g in groups for t in g]
    return spark.createDataFrame([(i, 300, t) for i, t in enumerate(rows)], "id long, n long, tokens binary")


def pairs_met(leaves, size):
    """The groups of ``size`` neighbouring ids of which two share a leaf."""
    nodes = {}
    for r in leaves.collect():
        nodes.setdefault((r.node, r.id // size), set()).add(r.id)
    return {g for (_, g), ids in nodes.items() if len(ids) > 1}


def test_large_nodes_with_the_same_classes_split_each_by_its_own_draws(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    groups = [[rng.integers(0, 2**32, J.COORDINATES)] * 12 for _ in range(40)]
    assert len(pairs_met(J.chosen_paths(sketches_of(spark, groups), 0.8, 0.99, 8, 3), 12)) >= 39


def test_default_plan_reaches_the_recall_at_the_threshold(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    pairs = []
    for _ in range(4000):
        a, b = rng.integers(0, 2**32, (2, J.COORDINATES))
        pairs.append([a, np.where(rng.random(J.COORDINATES) < 0.8, a, b)])
    met = pairs_met(J.chosen_paths(sketches_of(spark, pairs), 0.8, J.RECALL, 1, J.LEVELS), 2)  # nodes of two are large: split at both levels
    assert J.missed(J.planned(0.8, J.RECALL, J.LEVELS), 0.8, J.LEVELS) <= 1 - J.RECALL
    assert len(met) >= 0.997 * len(pairs)  # the tokens that pairs share vary, which costs a little


def test_recall_of_texts_at_the_threshold_when_every_node_splits(spark):
    rng = random.Random(12)
    rows = []
    for k in range(1000):
        base = [f"w{rng.randrange(10**6)}" for _ in range(304)]  # 300 shingles; six words change five each, the third word three: 267 of 333 are shared
        near = list(base)
        for at in (2, *rng.sample(range(10, 290, 20), 6)):
            near[at] = "x" + near[at]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(near))]
    sets = {i: shingles(t) for i, t in rows}
    exact = {k for k in range(1000) if len(sets[2 * k] & sets[2 * k + 1]) >= 0.8 * len(sets[2 * k] | sets[2 * k + 1])}
    got = {r.doc_id // 2 for r in J.joined_documents(spark.createDataFrame(rows, "doc_id long, text string"), bucket=1).where("n_links > 0").collect()}
    assert len(exact) > 300 and got <= exact and len(got) >= 0.99 * len(exact)


def test_chains_of_links(spark):
    rng = random.Random(13)
    words = [f"c{k}" for k in range(600)]
    rows = []
    for k in range(240):  # each text is near the ones before it, the first is far from the last
        words[2 * k % 600] = f"d{rng.randrange(10**6)}"
        rows.append((k, " ".join(words)))
    got = {r.doc_id: (r.n_links, r.component_id, r.kept) for r in J.joined_documents(spark.createDataFrame(rows, "doc_id long, text string"), bucket=32).collect()}
    assert got == brute(rows)


def test_nothing(spark):
    assert J.joined_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
