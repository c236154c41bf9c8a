"""Operator 10: packing of token sequences into windows, online and in bounded space.

Each partition keeps a fixed number of open windows. A document becomes full windows, which leave at once, and a
remainder, which goes to the open window that it fills best. Where it fits in none, the fullest window leaves and a new one
opens. What is open at the end of a partition goes on to a merge: windows of several partitions are again placed best-fit
into windows, in rounds, each with a fraction of the tasks of the one before, until one task holds the last few. All that a
task holds is the open windows; what it sends on is one row for each piece.

The ids of a text are those of its words, so equal words of a batch are encoded once. A word is what stands between ASCII
white space: the tokenizer drops white space, and neither its normaliser nor its pattern joins anything across it.

Sequence ids are those of the task that closed the window (stage, partition and a number), so they are unique without a shuffle.

Edge cases: a null text is an empty one, a document of just the end id; repeated rows are packed as often as they occur;
a null doc_id stays null; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import sys
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import bounded_batches, gathered, lean, stored
from textloom.llm.token_counts import slices

SLICE_BYTES = 8 << 20
SEEN_WORDS = 150_000
TOGETHER = 200
MARKS = ",.;:!?"
LETTERS = r"a-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}\x{400}-\x{481}"
OPEN_WINDOWS = 64
MERGE = 16

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary, is_open boolean"
PIECE = SCHEMA.replace(" long", "").replace(" binary", "").replace(" boolean", "").split(", ")
ARROW = pa.schema([(c, pa.int64()) for c in PIECE[:-2]] + [("ids", pa.binary()), ("is_open", pa.bool_())])


def little(ids: list[int]) -> bytes:
    own = array("I", ids)
    if sys.byteorder == "big":
        own.byteswap()
    return own.tobytes()


class WordEncoder:
    """Ids of texts by a tokenizer that works word by word."""

    def __init__(self, file: str) -> None:
        import json

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        with open(file) as f:
            spec = json.load(f)
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        self.by_word = steps[0].get("type") == "Split" and steps[0].get("invert") and "\\s" in str(steps[0].get("pattern"))
        pattern, normalizer = str(steps[0].get("pattern")), spec.get("normalizer") or {}
        lowers = any(n.get("type") == "Lowercase" for n in [normalizer, *normalizer.get("normalizers", [])])
        self.plain_words = lowers and repr(r"[\p{L}]+")[1:-1] in pattern and repr(r"[^\s\p{L}\p{N}]+")[1:-1] in pattern
        self.by_word &= not any(" " in t["content"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"])
        self.ends = np.zeros(0, bool)
        suffix = spec["model"].get("end_of_word_suffix")
        if suffix:
            ids = self.tokenizer.get_vocab()
            self.ends = np.zeros(max(ids.values()) + 1, bool)
            self.ends[[i for t, i in ids.items() if t.endswith(suffix)]] = True
        self.marks = dict(zip(MARKS, self.encode([*MARKS]), strict=True))
        self.seen: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        return [little(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def plain(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters only, many to a call: each is one word of the tokenizer too, so its last id tells where it ends."""
        out: list[bytes] = []
        for at in range(0, len(words), TOGETHER):
            own = words[at : at + TOGETHER]
            raw = self.encode([" ".join(own)])[0]
            last = np.flatnonzero(self.ends[np.frombuffer(raw, "<u4")]) + 1 if len(self.ends) else ()
            if len(last) == len(own):
                cut = [0, *(4 * last).tolist()]
                out += [raw[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
            else:
                out += self.encode(own)
        return out

    def words(self, words: pa.Array) -> list[bytes]:
        """Ids of each word. Where the tokenizer lower-cases and takes letters apart from marks, ASCII words are looked up in lower case, and without a mark
        after a letter, which is a word of its own; words with a part of a special token stay as they are, and so do all words of other tokenizers."""
        plain = pc.and_(pc.equal(pc.binary_length(words), pc.utf8_length(words).cast(pa.int64())), pc.invert(pc.match_substring(words, "<|")))
        marked = pa.array([False]).take(pa.array([0] * len(words), pa.int32()))
        if self.plain_words:
            words = pc.if_else(plain, pc.ascii_lower(words), words)
            marked = pc.match_substring_regex(words, f"[{LETTERS}][{MARKS}]$")
        bare = pc.if_else(marked, pc.utf8_slice_codeunits(words, 0, -1), words).dictionary_encode()
        tails = pc.if_else(marked, pc.utf8_slice_codeunits(words, -1, None), "").dictionary_encode()
        seen = self.seen
        keys = bare.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = [seen.get(w) for w in keys]
        late = [i for i, x in enumerate(found) if x is None]
        letters = [i for i in late if self.plain_words and keys[i].isalpha()]
        for i, x in zip(letters, self.plain([keys[i] for i in letters]), strict=True):
            found[i] = x
        others = [i for i in late if found[i] is None]
        for i, x in zip(others, self.encode([keys[i] for i in others]), strict=True):
            found[i] = x
        if len(seen) + len(late) > SEEN_WORDS:
            seen.clear()
        for i in late[:SEEN_WORDS]:
            if len(keys[i]) <= 32:
                seen[keys[i]] = found[i]
        ends = [self.marks.get(t, b"") for t in tails.dictionary.to_pylist()]
        return [found[i] + ends[t] for i, t in zip(bare.indices.to_numpy().tolist(), tails.indices.to_numpy().tolist(), strict=True)]

    def ids(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text, as unsigned 32-bit numbers."""
        if not self.by_word:
            yield from self.encode(texts.to_pylist())
            return
        lists = pc.ascii_split_whitespace(texts)
        table = lists.flatten().dictionary_encode()
        found = self.words(table.dictionary)
        index = table.indices.to_numpy().tolist()
        at = 0
        for n in pc.list_value_length(lists).to_numpy().tolist():
            yield b"".join([found[i] for i in index[at : at + n]])
            at += n


@lru_cache(2)
def encoder(file: str) -> WordEncoder:
    return WordEncoder(file)


class Packer:
    """The open windows of one task."""

    def __init__(self, size: int, windows: int, base: int) -> None:
        self.size, self.most, self.next = size, windows, base
        self.open: list[tuple[int, int]] = []  # (space left, window), sorted
        self.held: dict[int, list[list]] = {}
        self.out: list[list] = []

    def put(self, pieces: list[list], length: int) -> None:
        """Places what has to stay together: [doc_id, start, length, crc, doc_tokens, ids] each."""
        if length == self.size:
            self.close(self.new(), pieces)
            return
        i = bisect_left(self.open, (length, -1))
        if i < len(self.open):
            space, w = self.open.pop(i)
        else:
            if len(self.open) >= self.most:
                self.close(self.open.pop(0)[1])
            space, w = self.size, self.new()
        self.held.setdefault(w, []).extend(pieces)
        if space == length:
            self.close(w)
        else:
            insort(self.open, (space - length, w))

    def new(self) -> int:
        self.next += 1
        return self.next - 1

    def close(self, w: int, pieces: list[list] | None = None, is_open: bool = False) -> None:
        at = 0
        for p in self.held.pop(w, None) or pieces or ():
            self.out.append([*p[:5], w, at, p[5], is_open])
            at += p[2]

    def finish(self, last: bool) -> None:
        for _, w in self.open:
            self.close(w, is_open=not last)
        self.open = []

    def batch(self) -> pa.RecordBatch:
        rows, self.out = self.out, []
        columns = zip(*rows, strict=True) if rows else [[]] * len(ARROW)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ARROW, strict=True)], schema=ARROW)


def task_base(stage: int) -> int:
    """The first sequence id of this task: stage and partition above, room for 2**36 windows below."""
    from pyspark import TaskContext

    return (stage << 58) + (TaskContext.get().partitionId() << 36)


def pack(
    df: DataFrame, tokenizer_file: str, *, doc_id: str = "doc_id", text: str = "text", end_id: int = 1, size: int = 2048,
    windows: int = OPEN_WINDOWS, with_ids: bool = False, slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """One row for each piece of a document: doc_id, start (its document's ids before it), length, ids_crc32 (of the
    ids as little-endian unsigned 32-bit numbers), doc_tokens (with the end id), sequence_id, offset in that sequence,
    and with ``with_ids`` the ids themselves (binary, the same format).

    Other columns of ``df`` are not carried on.
    """

    @lean
    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, packer = encoder(tokenizer_file), Packer(size, windows, task_base(0))
        for b in gathered(batches, slice_bytes):
            texts = pc.fill_null(b[1].cast(pa.large_string()), "")
            sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
            docs = b[0].to_pylist()
            for at, to in slices(sizes, slice_bytes):
                for doc, ids in zip(docs[at:to], whole_ids(own, texts, at, to, int(sizes[at]), slice_bytes), strict=True):
                    pieces_of(packer, doc, ids, size, end_id, with_ids)
                if len(packer.out) > 2_000:
                    yield packer.batch()
        packer.finish(False)
        yield packer.batch()

    bounded_batches(df.sparkSession)
    source = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    done = stored(source.mapInArrow(first, SCHEMA), "packed")
    tasks = max(1, len(done.inputFiles()))
    results, left, stage = [done.where("not is_open")], done.where("is_open"), 1
    while True:
        tasks = -(-tasks // MERGE)
        last = tasks == 1
        merged = stored(left.repartition(tasks, F.col("sequence_id")).sortWithinPartitions("sequence_id", "offset").mapInArrow(
            merger(size, windows, stage, last), SCHEMA), "packed")
        results.append(merged.where("not is_open"))
        if last:
            break
        left, stage = merged.where("is_open"), stage + 1
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return out.select(*PIECE[: -1 if with_ids else -2])


def whole_ids(own: WordEncoder, texts: pa.Array, at: int, to: int, n_bytes: int, slice_bytes: int) -> Iterator[bytes]:
    """The ids of the texts at..to-1, without the end id."""
    if own.by_word and to == at + 1 and n_bytes > 2 * slice_bytes:
        yield b"".join(x for p in word_parts(texts[at].as_py(), slice_bytes) for x in own.ids(pa.array([p], pa.large_string())))
    else:
        yield from own.ids(texts.slice(at, to - at))


def word_parts(text: str, most: int) -> Iterator[str]:
    """A long text in parts, cut at blanks or line ends."""
    at = 0
    while len(text) - at > most:
        cut = min((x for x in (text.find(" ", at + most), text.find("\n", at + most)) if x >= 0), default=-1)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut + 1
    yield text[at:]


def pieces_of(packer: Packer, doc: int | None, raw: bytes, size: int, end_id: int, with_ids: bool) -> None:
    """Cuts one document into full windows and a remainder, and places them."""
    raw += end_id.to_bytes(4, "little")
    n = len(raw) // 4
    for start in range(0, n, size):
        own = raw[4 * start : 4 * (start + size)]
        packer.put([[doc, start, len(own) // 4, zlib.crc32(own), n, own if with_ids else None]], len(own) // 4)


def merger(size: int, windows: int, stage: int, last: bool):
    """Places open windows, each as a whole, into windows."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(size, windows * (MERGE if last else 1), task_base(stage))
        w, held, length = None, [], 0
        for b in batches:
            for r in b.to_pylist():
                if r["sequence_id"] != w and held:
                    packer.put(held, length)
                    held, length = [], 0
                w = r["sequence_id"]
                held.append([r[c] for c in PIECE[:5]] + [r["ids"]])
                length += r["length"]
            if len(packer.out) > 2_000:
                yield packer.batch()
        if held:
            packer.put(held, length)
        packer.finish(last)
        yield packer.batch()

    return run
