import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest

from textloom.llm import packing, token_counts

TEXTS = [None, "", " ", "a", " a", "a ", "a  b", "a\nb \n c", "x<s> y</s>", "ñé 12 " * 50, "▁ a▁b ▁", "\t　x", "w" * 300, "a b" * 400 + " "]


def test_counts_are_those_of_the_library(spark):
    import sentencepiece

    file = public_tokenizers.path("piece_bpe_32k.model")
    whole = sentencepiece.SentencePieceProcessor(model_file=file)
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(TEXTS * 2)], "doc_id long, text string, n_bytes int")
    for slice_bytes in (1 << 20, 20):
        got = {r.doc_id: r for r in token_counts.token_counts(df, file, limit=100, slice_bytes=slice_bytes).collect()}
        for i, t in enumerate(TEXTS * 2):
            n = len(whole.encode(t or ""))
            assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 100), (t, slice_bytes)
    assert token_counts.token_counts(df.limit(0), file).count() == 0
    dotted = token_counts.token_counts(df.withColumnRenamed("n_bytes", "a.b"), file)
    assert dotted.columns == ["doc_id", "a.b", "n_bytes", "n_tokens", "over_limit"] and {r["a.b"] for r in dotted.collect()} == {7}


WORDS = [None, "", "Hello wörld's  12a!\n<|endoftext|> a<|startoftext|>b", "İ ẞ Σας", "áb ́c", "x " * 5000, "\x1c a\x1cb  c", "one two"]


@pytest.mark.parametrize("slice_bytes", [1 << 20, 30])
def test_packing_round_trip(spark, slice_bytes):
    from tokenizers import Tokenizer

    file = public_tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(file)
    rows = [(i, WORDS[i % len(WORDS)]) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(20)
    pieces = packing.pack(df, file, size=64, windows=4, with_ids=True, slice_bytes=slice_bytes).collect()
    of_doc, of_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        ids = np.frombuffer(p.ids, "<u4").tolist()
        assert len(ids) == p.length and zlib.crc32(p.ids) == p.ids_crc32
        of_doc[p.doc_id].append((p.start, ids, p.doc_tokens))
        of_sequence[p.sequence_id].append((p.offset, p.length))
    for i, t in rows:
        want = [*whole.encode(t or "", add_special_tokens=False).ids, 1]
        assert [x for _, ids, _ in sorted(of_doc[i]) for x in ids] == want
        assert {n for *_, n in of_doc[i]} == {len(want)}
    used = 0
    for parts in of_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
        used += at
    assert used / (64 * len(of_sequence)) > 0.95


def test_packing_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(df, public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_ids_of_slices():
    own = packing.encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert own.by_word
    assert [len(x) for x in own.ids(pa.array(["a b", "", "c"], pa.large_string()))] == [8, 0, 4]


def test_tokenizers_of_other_kinds_keep_their_ids(tmp_path):
    """One that keeps case, one that doesn't take marks from letters, one that doesn't work by words: ids are the library's."""
    import json

    from tokenizers import Tokenizer

    with open(public_tokenizers.path("word_bpe_49k.json")) as f:
        spec = json.load(f)
    cased = {**spec, "normalizer": {"type": "NFC"}}
    joined = json.loads(json.dumps(spec))
    joined["pre_tokenizer"]["pretokenizers"][0]["pattern"] = {"Regex": r"[^\s]+"}
    files = [public_tokenizers.path("byte_bpe_50k.json")]
    for name, own in (("cased", cased), ("joined", joined)):
        files.append(f"{tmp_path}/{name}.json")
        with open(files[-1], "w") as f:
            json.dump(own, f)
    texts = ["Hello, World. Again; HELLO world!", "", "a  b\tc", "Wörld? ñé, x<|endoftext|>y"]
    for file in files:
        whole = Tokenizer.from_file(file)
        got = [np.frombuffer(x, "<u4").tolist() for x in packing.WordEncoder(file).ids(pa.array(texts, pa.large_string()))]
        assert got == [whole.encode(t, add_special_tokens=False).ids for t in texts], file
