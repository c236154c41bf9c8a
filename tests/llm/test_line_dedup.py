import random
from collections import defaultdict

from textloom.llm import line_dedup

BLANK = "\t\n\x0b\f\r "


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(BLANK))


def brute(rows, min_chars, min_docs):
    docs = defaultdict(set)
    for d, t in rows:
        if d is not None:
            for line in (t or "").split("\n"):
                if len(key(line)) >= min_chars:
                    docs[key(line)].add(d)
    often = {k: max(v) for k, v in docs.items() if len(v) >= min_docs}
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if d is None or often.get(key(x), d) == d]
        out.append((d, len(lines), len(lines) - len(kept), t if len(kept) == len(lines) else "\n".join(kept)))
    return sorted(out, key=str)


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    stock = ["alpha Beta ", "ALPHA beta", "  ñandú ÑA\t", "Ñandú ña", "x", "", "gamma delta\r", "one two three", "\x0bepsilon zeta"]
    rows = [(i, "\n".join(rng.choice(stock) for _ in range(rng.choice([1, 2, 5, 150])))) for i in range(50)]
    rows += [(50, None), (51, ""), (7, "alpha beta\nalpha beta\nnew one here"), (7, "alpha beta\nalpha beta\nnew one here"), (None, "alpha beta")]
    df = spark.createDataFrame([(*r, "v", 1) for r in rows], "doc_id long, text string, n_lines string, drops int").repartition(4)
    for min_chars, min_docs, heavy in ((5, 5, 1000), (5, 5, 4), (1, 2, 1000), (5, 1000, 1000)):
        monkeypatch.setattr(line_dedup, "HEAVY", heavy)
        monkeypatch.setattr(line_dedup, "LEAST_HEAVY", 1)
        bitmaps = line_dedup.keep_bitmaps(df, min_chars=min_chars, min_docs=min_docs)
        got = line_dedup.apply_bitmaps(df, bitmaps)
        assert got.columns == ["doc_id", "text", "drops", "n_lines", "n_dropped"]
        assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()), key=str) == brute(rows, min_chars, min_docs)
    empty = df.limit(0)
    assert line_dedup.apply_bitmaps(empty, line_dedup.keep_bitmaps(empty)).count() == 0


def test_common_line_is_decided_without_a_shuffle_of_its_rows(spark):
    line = "a line that is long enough to count as one here"
    df = spark.range(3000).selectExpr("id as doc_id", f"'{line}' as text")
    cut = line_dedup.apply_bitmaps(df, line_dedup.keep_bitmaps(df))
    assert [(r.doc_id, r.text) for r in cut.where("n_dropped = 0").collect()] == [(2999, line)]
    assert cut.where("text = ''").count() == 2999


def test_hashes_are_dealt_by_range_once(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = line_dedup.keep_bitmaps(df)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning(h1" in plan and "hashpartitioning(h1" not in plan and "Python" not in plan


def test_columns_with_inner_names(spark):
    line = "a line that is long enough to be looked at by all"
    rows = [(k, line + "\nown", k, "m", "d") for k in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, id long, mark string, drops string")
    for names in (["id", "mark", "keeps"], ["id", "mark", "drops"], ["__id", "__mark", "__drops"], ["ID", "row_mark", "Keeps"]):
        own = df.toDF("doc_id", "text", *names)
        got = line_dedup.apply_bitmaps(own, line_dedup.keep_bitmaps(own)).collect()
        assert sorted((r.doc_id, r[names[0]], r[names[1]], r[names[2]], r.text) for r in got) == [(k, k, "m", "d", (line + "\nown") if k == 5 else "own") for k in range(6)]


def test_many_hot_lines(spark, monkeypatch):
    """One line has 5 % of all rows and 400 have 0.2 % each: none is left to one task's stream, and beyond the bound of the broadcast they are joined."""
    rng = random.Random(8)
    hot, many = "the one hot line", [f"one of the many hot lines {k}" for k in range(400)]
    lines = [hot] * 2000 + many * 80 + [f"a rare line {k}" for k in range(6000)]
    rng.shuffle(lines)
    rows = [(i, "\n".join(lines[i * 50 : i * 50 + 50])) for i in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    monkeypatch.setattr(line_dedup, "HEAVY", 20)
    monkeypatch.setattr(line_dedup, "LEAST_HEAVY", 10)
    monkeypatch.setattr(line_dedup, "MOST_LIGHT", 60)
    kept = line_dedup.stored
    for broadcast in (500_000, 10):
        sizes = {}
        monkeypatch.setattr(line_dedup, "MOST_BROADCAST", broadcast)
        monkeypatch.setattr(line_dedup, "stored", lambda x, name, sizes=sizes: sizes.setdefault(name, kept(x, name)))
        got = line_dedup.apply_bitmaps(df, line_dedup.keep_bitmaps(df, min_chars=5))
        assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()), key=str) == brute(rows, 5, 5)
        assert sizes["often"].count() == 401


def test_names_with_dots(spark):
    df = spark.createDataFrame([(i, "a line that is long enough to count as one here", "v") for i in range(6)], "doc_id long, text string, `a.b` string")
    cut = line_dedup.apply_bitmaps(df, line_dedup.keep_bitmaps(df))
    assert cut.columns == ["doc_id", "text", "a.b", "n_lines", "n_dropped"]
    assert sorted((r.doc_id, r["a.b"], r.n_dropped) for r in cut.collect()) == [(i, "v", int(i < 5)) for i in range(6)]
