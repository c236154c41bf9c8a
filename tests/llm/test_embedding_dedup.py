import numpy as np

from textloom.llm import embedding_dedup
from textloom.llm.components import components


def brute(rows, threshold):
    ok = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok[i] = np.array(v, float)
    links = {i: set() for i in ok}
    for i, x in ok.items():
        for j, y in ok.items():
            if i < j and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                links[i].add(j)
                links[j].add(i)
    out = {}
    for i in {r[0] for r in rows if r[0] is not None}:
        seen, todo = {i}, [i]
        while todo:
            for k in links.get(todo.pop(), ()):
                if k not in seen:
                    seen.add(k)
                    todo.append(k)
        out[i] = (len(links.get(i, ())), min(seen), min(seen) == i)
    return out


def test_against_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = []
    for c in range(30):
        base = rng.standard_normal(16)
        for k in range(80 if c == 0 else 3):
            rows.append((len(rows) * 7 % 1009, (base + 0.02 * rng.standard_normal(16)).tolist()))
    rows += [(5000, None), (5001, []), (5002, [0.0] * 16), (5003, [None] * 16), (5004, [float("nan")] * 16), (5005, [float("inf")] + [1.0] * 15), (5006, [1.0, 2.0]), (5007, [2.0, 4.0])]
    rows += [(rows[3][0], None), (rows[4][0], rows[4][1])]
    df = spark.createDataFrame([(*r, "x") for r in [*rows, (None, rows[0][1])]], "vec_id long, embedding array<double>, n_links string").repartition(5)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.linked(df, recall=0.999999, block=20).collect()}
    assert got.pop(None) == (0, None, True)
    assert got == brute(rows, 0.9)


def test_exact_copies_meet_once(spark):
    rng = np.random.default_rng(6)
    base = rng.standard_normal((6, 8))
    rows = [(k, base[k % 6].tolist()) for k in range(3000)] + [(3000 + k, (base[0] + 0.01 * rng.standard_normal(8)).tolist()) for k in range(40)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.linked(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), block=16).collect()}
    x = np.array([np.array(v, np.float32) for _, v in rows], float)
    x /= np.sqrt((x * x).sum(1))[:, None]
    near = x @ x.T >= 0.9
    assert {k: n for k, (n, _, _) in got.items()} == {k: int(near[k].sum()) - 1 for k in range(len(rows))}
    assert all(got[k][1] == int(np.flatnonzero(near[k])[0]) for k in range(len(rows)))


def test_layout():
    assert embedding_dedup.layout(0, 0.9, 0.99)[0] == 4
    for rows in (100, 50_000, 10**9):
        bits, tables = embedding_dedup.layout(rows, 0.9, 0.99)
        p = (1 - np.arccos(0.9) / np.pi) ** bits
        assert (1 - p) ** tables <= 0.01


def test_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embedding_dedup.linked(df).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(10, 40)] + [(50, 51), (60, 50), (7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 10 for i in range(11, 41)}, 51: 50, 60: 50}
