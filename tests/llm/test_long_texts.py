"""Texts of megabytes go through whole, beside empty ones."""

import zlib

import public_tokenizers
from pyspark.sql import functions as F

from textloom.llm import decontaminate, jaccard_join, language_id, line_dedup, packing, suffix_dedup, token_counts

WORDS = [f"w{i % 7919}x{i % 104729}" for i in range(250_000)]
LONG = " ".join(WORDS)
ONE_WORD = "a" * 300_000


def docs(spark):
    rows = [(1, LONG, "en"), (2, LONG + " end", "en"), (3, "", "en"), (4, None, None), (5, ONE_WORD, "de"), (6, "\n" * 50_000, "de")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)


def test_near_copies_and_passages(spark):
    near = {r.doc_id: (r.n_links, r.component_id) for r in jaccard_join.joined_documents(docs(spark)).collect()}
    assert near == {1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (0, 4), 5: (0, 5), 6: (0, 6)}
    spans = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in suffix_dedup.repeated_spans(docs(spark)).collect()}
    assert spans == {1: [(0, 250_000)], 2: [(0, 250_000)], 3: [], 4: [], 5: [], 6: []}


def test_hits_and_lines(spark):
    bench = spark.createDataFrame([(1, " ".join(WORDS[-12:])), (2, "not there at all")], "item_id long, text string")
    found = {r.doc_id: (r.n_words, len(r.hits), r.item_ids) for r in decontaminate.contamination(docs(spark), bench, columns=["doc_id"]).collect()}
    assert found[1] == (250_000, 12, ["1"]) and found[2] == (250_001, 12, ["1"]) and found[5] == (1, 0, []) and found[4] == (0, 0, [])
    cut = line_dedup.apply_bitmaps(docs(spark), line_dedup.keep_bitmaps(docs(spark), min_docs=2))
    assert {r.doc_id: r.n_lines for r in cut.collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 50_001}


def test_tokens(spark):
    import sentencepiece
    from tokenizers import Tokenizer

    file = public_tokenizers.path("piece_bpe_32k.model")
    whole = sentencepiece.SentencePieceProcessor(model_file=file)
    counts = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs(spark).select("doc_id", "text"), file, slice_bytes=100_000).collect()}
    assert counts[1] == len(whole.encode(LONG)) and counts[5] == len(whole.encode(ONE_WORD))
    words = public_tokenizers.path("word_bpe_49k.json")
    ids = Tokenizer.from_file(words).encode(LONG, add_special_tokens=False).ids + [1]
    pieces = packing.pack(docs(spark).where("doc_id = 1"), words, slice_bytes=100_000).orderBy("start").collect()
    assert sum(p.length for p in pieces) == len(ids) == pieces[0].doc_tokens
    raw = b"".join(i.to_bytes(4, "little") for i in ids)
    assert all(zlib.crc32(raw[4 * p.start : 4 * (p.start + p.length)]) == p.ids_crc32 for p in pieces)


def test_language(spark):
    model = language_id.learn(docs(spark))
    found = {r.doc_id: r.lang_pred for r in language_id.predict(docs(spark), model).select("doc_id", "lang_pred").collect()}
    assert found == {1: "en", 2: "en", 3: "und", 4: "und", 5: "de", 6: "und"}
    assert language_id.predict(docs(spark), model).where(F.col("score") > 1).count() == 0
