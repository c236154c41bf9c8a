import random
import re
import tracemalloc

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from textloom.llm.decontaminate import Tables, blocks, contamination, scan

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, bench, width):
    out = []
    for doc, text in docs:
        w, hit, items = split(text), set(), set()
        for item, t in bench:
            b = split(t)
            n = min(width, len(b))
            grams = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if n else ()
            for i in range(len(w) - n + 1) if n else ():
                if tuple(w[i : i + n]) in grams:
                    hit.update(range(i, i + n))
                    items |= {str(item)} if item is not None else set()
        out.append((doc, len(w), sorted(hit), sorted(items)))
    return out


def test_against_brute_force(spark):
    rng = random.Random(5)
    vocabulary = ["a", "B", "c9", "ñ", "dd", "É"]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n"]) for _ in range(n))
    bench = [(i, text(rng.choice([0, 1, 2, 3, 5, 8, 12]) if i > 2 else 9)) for i in range(14)] + [(3, text(6)), (None, text(7)), (50, None)]
    docs = [(i, text(rng.choice([0, 1, 4, 30, 700]))) for i in range(60)] + [(60, None), (61, ""), (7, bench[4][1]), (7, bench[4][1])]
    d = spark.createDataFrame([(*r, 5) for r in docs], "doc_id long, text string, n_words int").repartition(3)
    b = spark.createDataFrame(bench, "item_id long, text string")
    for width in (4, 10):
        want = sorted(brute(docs, bench, width), key=str)
        for block in (1 << 20, 12):
            got = [(r.doc_id, r.n_words, r.hits, r.item_ids) for r in contamination(d, b, width=width, columns=["doc_id"], block_bytes=block, slice_bytes=200).collect()]
            assert sorted(got, key=str) == want
    assert contamination(d, b.limit(0)).select("n_words", "hits").where("size(hits) > 0").count() == 0
    assert contamination(d.limit(0), b).count() == 0


def test_columns_of_any_name_and_many_blocks(spark):
    docs = spark.createDataFrame([(1, "one two three four", "x"), (2, "five six", "y")], "doc_id long, text string, __text string")
    bench = spark.createDataFrame([(f"i{k}", t) for k, t in enumerate(["two three", "six", "never said", "four", "seven", "one two", "nine", "ten"])], "item_id string, text string")
    for size in (1, 10, 1 << 20):
        got = {r.doc_id: (r["__text"], r.hits, r.item_ids) for r in contamination(docs, bench, block_bytes=size).collect()}
        assert got == {1: ("x", [0, 1, 2, 3], ["i0", "i3", "i5"]), 2: ("y", [1], ["i1"])}


def test_tables_of_large_blocks_are_small(spark):
    """32 MB of items in blocks: the tables keep less than 15 bytes for each byte of text, and no object for each window."""
    word = F.transform(F.sequence(F.lit(0), F.lit(199)), lambda k: F.concat(F.lit("w"), F.hex(F.pmod(F.xxhash64("id", k), F.lit(50_000)))))
    bench = spark.range(32_000).select(F.concat(F.lit("i"), F.col("id")).alias("item_id"), F.array_join(word, " ").alias("text"))
    size = words = found = 0
    planted = bench.where("item_id = 'i31999'").first().text.split(" ")
    docs = pa.array(["before " + " ".join(planted[20:45]) + " after", " ".join(planted[20:29])], pa.large_string())
    tracemalloc.start()
    try:
        for block in blocks(bench, "item_id", "text", 1 << 20, 8 << 20):
            n = pc.sum(pc.binary_length(block["text"])).as_py()
            before = tracemalloc.get_traced_memory()[0]
            tracemalloc.reset_peak()
            tables = Tables(block, 10)
            kept, peak = tracemalloc.get_traced_memory()
            assert kept - before < 15 * n and peak - before < 30 * n + (32 << 20)  # the table of powers has a fixed size
            count, hits, items = scan(docs, tables)
            if items[0].as_py():
                found += 1
                assert items.to_pylist() == [["i31999"], []] and hits.to_pylist() == [list(range(1, 26)), []] and count.tolist() == [27, 9]
            size, words = size + n, words + 200 * block.num_rows
            assert 200 * block.num_rows < (1 << 20) + 200
            del tables, block
    finally:
        tracemalloc.stop()
    assert found == 1 and words == 6_400_000 and size > 32e6


def test_a_window_of_many_items(spark):
    common = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    bench = spark.createDataFrame([(f"i{k % 1500:04}", f"own{k} {common} {common}" if k % 2 else common.upper()) for k in range(3000)], "item_id string, text string")
    docs = spark.createDataFrame([(1, f"{common} {common} x"), (2, common[:-1]), (3, f"x. {common}! {common}")], "doc_id long, text string")
    got = {r.doc_id: r for r in contamination(docs, bench).collect()}
    assert got[1].item_ids == got[3].item_ids == [f"i{k:04}" for k in range(1500)] and got[2].item_ids == []
    assert got[1].hits == list(range(20)) and got[3].hits == list(range(1, 21)) and got[2].hits == []


def test_names_with_dots(spark):
    docs = spark.createDataFrame([(1, "one two three", "x"), (2, None, "y")], "doc_id long, text string, `a.b` string")
    bench = spark.createDataFrame([("i", "two three")], "item_id string, text string")
    for size in (1, 1 << 20):
        got = {r.doc_id: (r["a.b"], r.hits, r.n_words) for r in contamination(docs, bench.union(bench), block_bytes=size).collect()}
        assert got == {1: ("x", [1, 2], 3), 2: ("y", [], 0)}
