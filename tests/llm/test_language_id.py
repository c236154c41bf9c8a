import random
import zlib

import numpy as np
import pytest

from textloom.llm import language_id as L

WORDS = {"xx": ["haba", "lomo", "Rita", "sona"], "yy": ["krrt", "zvyk", "plšt", "hmčk"]}


def rows(n):
    rng = random.Random(1)
    text = lambda lang, k: " ".join(rng.choice(WORDS[lang]) for _ in range(k))
    return [(i, text(lang := rng.choice(["xx", "yy"]), rng.randint(3, 60)), lang) for i in range(n)]


def test_held_out_accuracy_and_edges(spark):
    data = rows(400)
    data += [(1000, None, "xx"), (1001, "", "xx"), (1002, "12 .!", "yy"), (1003, "haba lomo", None), (None, "krrt zvyk", "xx"), (5, data[5][1], data[5][2])]
    df = spark.createDataFrame([(*r, 3) for r in data], "doc_id long, text string, lang string, score int").repartition(4)
    from pyspark.sql import functions as F

    model = L.learn(df.where(~L.held_out(F.col("doc_id"))))
    assert model[0] == ["xx", "yy"] and np.allclose(model[1].sum(1), 1)
    got = L.predict(df, model).withColumn("held_out", L.held_out(F.col("doc_id"))).collect()
    assert len(got) == len(data)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1
        if r.doc_id in (1000, 1001, 1002):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        elif r.doc_id is not None and r.doc_id < 1000:
            assert r.lang_pred == r.lang
    none = L.predict(df, L.learn(df.limit(0)))
    assert {r.lang_pred for r in none.collect()} == {"und"}
    assert L.predict(df.limit(0), model).count() == 0


def test_mixture_shares(spark):
    df = spark.createDataFrame(rows(400), "doc_id long, text string, lang string")
    model = L.learn(df)
    text = " ".join(WORDS["xx"] * 30 + WORDS["yy"] * 10)
    shares = L.predict(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first().lang_shares
    assert abs(shares["xx"] - 0.75) < 0.08 and abs(shares["yy"] - 0.25) < 0.08


def test_em_reaches_the_best_shares():
    rng = np.random.default_rng(0)
    p = rng.dirichlet(np.ones(50), 2)
    n = np.round(2000 * (0.3 * p[0] + 0.7 * p[1]))
    own, value = L.shares(p, n, 200)
    best = max(n @ np.log(a * p[0] + (1 - a) * p[1]) for a in np.linspace(0.01, 0.99, 99))
    assert value >= best - 0.5 and abs(own[0] - 0.3) < 0.05


def test_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "good morning to all of you", "en", "x", "y")], "doc_id long, text string, lang string, __text string, Text_ string")
    row = L.predict(df, L.learn(df)).first()
    assert (row["__text"], row["Text_"], row.lang_pred) == ("x", "y", "en")


def test_many_labels(spark):
    rows = [(k, f"{chr(97 + k // 26)}{chr(97 + k % 26)}q " * 9, f"l{k}") for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels, p = L.learn(df)
    assert len(labels) == 300 and p.dtype == np.float32 and np.allclose(p.sum(1), 1, atol=1e-4)
    with pytest.raises(ValueError):
        L.learn(df, most_labels=299)


def test_names_with_dots(spark):
    df = spark.createDataFrame([(*r, 3) for r in rows(60)], "doc_id long, text string, lang string, `a.b` int")
    got = L.predict(df, L.learn(df)).collect()
    assert len(got) == 60 and {r["a.b"] for r in got} == {3}
