import random
import zlib

import corpus_pipeline as P
import public_tokenizers
from tokenizers import Tokenizer


def test_stages(spark, tmp_path):
    rng = random.Random(3)
    vocabulary = ["and", "the", "of", "river", "stone", "walks", "green", "under", "seven", "houses", "near", "bridge"]
    text = lambda n: " ".join(rng.choice(vocabulary) + str(rng.choice("abcdefgh")) for _ in range(n))
    line = "This line is the same in every one of these documents."
    clean = [(i, text(120), "en") for i in range(60)]
    bench = [(1, text(30)), (2, text(12))]
    copies = [(100 + k, clean[k][1], "en") for k in range(5)] + [(200, " ".join(clean[7][1].split()[:-2] + ["other", "end"]), "en")]
    leaks = [(300 + k, text(40) + " " + bench[k][1] + " " + text(40), "en") for k in range(2)]
    lined = [(400 + k, line + "\n" + text(80), "en") for k in range(6)] + [(410, line, "en"), (411, line.upper(), None)]
    junk = [(500, None, "en"), (501, "", None), (502, "123 ,,, 456", "en")]
    rows = clean + copies + leaks + lined + junk
    docs = spark.createDataFrame([(i, t, g, "s", None if t is None else len(t), 1) for i, t, g in rows], "doc_id long, text string, lang string, source string, n_chars long, extra int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = docs
    ids = {}
    for name, stage in P.STAGES[:-1]:
        out = P.stored(stage(spark, out, str(tmp_path)), name)
        assert out.columns == P.COLUMNS
        ids[name] = {r.doc_id for r in out.select("doc_id").collect()}
    everything = {i for i, *_ in rows}
    assert ids["language_id"] == everything - {500, 501, 502}
    assert ids["line_dedup"] == ids["language_id"] - {410}
    assert {r.doc_id: r.n_chars == len(r.text) for r in out.collect()} == {i: True for i in ids["decontaminate"]}
    assert ids["jaccard_join"] == ids["line_dedup"] - {100, 101, 102, 103, 104, 200}
    assert ids["decontaminate"] == ids["jaccard_join"] - {300, 301}
    packed = P.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == ids["decontaminate"]
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in out.collect():
        want = b"".join(i.to_bytes(4, "little") for i in [*whole.encode(r.text or "", add_special_tokens=False).ids, 1])
        own = sorted((p.start, p.length, p.ids_crc32) for p in packed if p.doc_id == r.doc_id)
        assert [(a, n, zlib.crc32(want[4 * a : 4 * (a + n)])) for a, n, _ in own] == own and sum(n for _, n, _ in own) * 4 == len(want)


def test_stages_against_brute_force(spark, tmp_path):
    """Lines, near duplicates and benchmark windows by plain loops over random documents, each stage on what the one before kept."""
    from tests.llm.test_jaccard_join import WORD, brute

    rng = random.Random(21)
    word = lambda: f"{rng.choice(['ri', 'sto', 'wal', 'gre', 'un', 'sev'])}{rng.choice(['ver', 'ne', 'king', 'en', 'der'])}{rng.randrange(300)}"
    text = lambda n: " ".join(word() for _ in range(n))
    lines = [f"  Line number {k} comes back in other Documents, often so " for k in range(12)]
    bench = [(k, text(rng.choice([3, 9, 10, 11, 40]))) for k in range(12)] + [(50, None), (51, "!!")]
    rows = []
    for i in range(220):
        t = text(rng.choice([8, 60, 150]))
        if rows and rng.random() < 0.3:
            words = rng.choice(rows)[1].split(" ")
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                words[rng.randrange(len(words))] = word()
            t = " ".join(words)
        if rng.random() < 0.2:
            own = rng.choice(bench[:12])[1].split(" ")
            t = t + " " + " ".join(own[rng.choice([0, 0, 2]) :]) + " " + text(5)
        for _ in range(rng.choice([0, 0, 1, 3])):
            t = rng.choice([t + "\n" + rng.choice(lines), rng.choice(lines).upper() + "\n" + t])
        rows.append((1000 - i, t))
    rows += [(2000 + k, lines[k % 2] + "\n" + lines[2]) for k in range(3)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\f\r"))
    holders = {}
    for i, t in rows:
        for x in t.split("\n"):
            holders.setdefault(key(x), set()).add(i)
    goes = lambda i, x: len(key(x)) >= 40 and len(holders[key(x)]) >= 5 and max(holders[key(x)]) != i
    want = {i: "\n".join(kept) for i, t in rows if (kept := [x for x in t.split("\n") if not goes(i, x)])}
    out = P.stored(P.drop_repeated_lines(spark, docs, str(tmp_path)), "lines")
    assert {r.doc_id: r.text for r in out.collect()} == want and want != dict(rows)

    kept = {i: want[i] for i, (_, _, stays) in brute(list(want.items())).items() if stays}
    out = P.stored(P.drop_near_duplicates(spark, out, str(tmp_path)), "near")
    assert {r.doc_id: r.text for r in out.collect()} == kept and len(kept) < len(want)

    words = lambda t: WORD.findall(key(t or ""))
    windows = {tuple(w[k : k + 10]) for _, t in bench if (w := words(t)) for k in range(max(1, len(w) - 9))}
    clean = {i: t for i, t in kept.items() if not any(tuple(w[k : k + n]) in windows for w in [words(t)] for n in range(1, 11) for k in range(len(w) - n + 1))}
    out = P.drop_contaminated(spark, out, str(tmp_path))
    assert {r.doc_id: r.text for r in out.collect()} == clean and len(clean) < len(kept)


def test_nothing(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_texts_that_share_an_id_stay(spark):
    from corpus_pipeline import drop_near_duplicates

    rows = [(1, "one text of its own here", "en", "a", 24), (1, "another text that differs much", "en", "b", 30), (1, "one text of its own here", "en", "a", 24), (2, "a third text for the second id", "en", "a", 31)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = drop_near_duplicates(spark, docs, "").collect()
    assert sorted((r.doc_id, r.text) for r in got) == sorted({r[:2] for r in rows})
