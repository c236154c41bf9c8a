"""Operator 7: token counts of whole texts.

Texts go to Python in Arrow batches and only lengths come back. A batch is cut into slices of about equal numbers of
bytes, a text above the slice size into parts at safe boundaries, so the work and memory of one call of the tokenizer
don't depend on how long single texts are.

A boundary is safe if no token can cross it. For a sentencepiece model without normalisation, in which no piece holds
the space mark after another character, that is every place between a non-space and a space. So a text is a sequence
of units (some spaces, then non-spaces), and its count is the sum over its units. Equal units of a slice are encoded
once, and the counts of units seen before come from a table of bounded size. A model of another kind gets whole texts.

Edge cases: a null text counts as empty (0 bytes, 0 tokens); rows stay as they are, repeated ones too; an empty table
gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.common import bounded_batches, gathered, lean, mapped

SLICE_BYTES = 8 << 20
SEEN_UNITS = 300_000
UNIT = re.compile(" +[^ ]*")


class UnitCounter:
    """Counts tokens with a sentencepiece model."""

    def __init__(self, model_file: str) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.encoder = sentencepiece.SentencePieceProcessor(model_file=model_file)
        proto = sentencepiece_model_pb2.ModelProto()
        with open(model_file, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        self.splits = (
            not spec.precompiled_charsmap
            and spec.add_dummy_prefix
            and not spec.remove_extra_whitespaces
            and not proto.trainer_spec.treat_whitespace_as_suffix
            and not any("▁" in p.piece.lstrip("▁") or p.type == p.USER_DEFINED for p in proto.pieces)
        )
        self.seen: dict[str, int] = {}
        first, both = self.whole(["a", "a "])
        self.lone = both - first  # tokens of a unit of one space, which the encoder doesn't put before an empty text

    def whole(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.encoder.encode(texts, num_threads=1)]

    def units(self, units: list[str]) -> list[int]:
        """Tokens of each unit, given without its first space, which the encoder puts there."""
        seen = self.seen
        out = [seen.get(u, -1) for u in units]
        new = [i for i, n in enumerate(out) if n < 0]
        if len(seen) + len(new) > SEEN_UNITS:
            seen.clear()
        for i, n in zip(new, self.whole([units[i] for i in new]), strict=True):
            out[i] = n = n if units[i] else self.lone
            if len(units[i]) <= 64 and len(seen) < SEEN_UNITS:
                seen[units[i]] = n
        return out

    def lengths(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text of a slice without nulls."""
        if not self.splits:
            return np.array(self.whole(texts.to_pylist()), np.int64)
        out = np.zeros(len(texts), np.int64)
        empty = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        # a second space in a row, or one at an end, belongs to a unit that begins with several spaces
        odd = ~empty & pc.match_substring_regex(texts, "^ |  | $").to_numpy(zero_copy_only=False)
        plain = np.flatnonzero(~empty & ~odd)
        if len(plain):
            lists = pc.split_pattern(texts.take(pa.array(plain)), " ")
            table = lists.flatten().dictionary_encode()
            each = np.array(self.units(table.dictionary.to_pylist()), np.int64)[table.indices.to_numpy()]
            first = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy())))
            out[plain] = np.add.reduceat(each, first[:-1])
        for i in np.flatnonzero(odd):
            out[i] = sum(self.units([u[1:] for u in UNIT.findall(" " + texts[int(i)].as_py())]))
        return out


@lru_cache(2)
def counter(model_file: str) -> UnitCounter:
    return UnitCounter(model_file)


def slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Neighbouring rows of about ``most`` bytes together; a larger row is alone."""
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + most, "right")))
        yield at, to
        at = to


def long_parts(text: str, most: int) -> Iterator[str]:
    """A text cut before single spaces into parts of about ``most`` characters; the space at a cut is left out."""
    at = 0
    while len(text) - at > most:
        cut = text.find(" ", at + most)
        while cut > 0 and text[cut - 1] == " ":
            cut = text.find(" ", cut + 1)
        if cut < 0 or cut == len(text) - 1:
            break
        yield text[at:cut]
        at = cut + 1
    yield text[at:]


def count_texts(texts: pa.Array, model_file: str, slice_bytes: int = SLICE_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and tokens of each text of a batch."""
    own = counter(model_file)
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros(len(texts), np.int64)
    for at, to in slices(sizes, slice_bytes):
        if own.splits and to == at + 1 and sizes[at] > slice_bytes:
            for part in long_parts(texts[at].as_py(), slice_bytes):
                out[at] += int(own.lengths(pa.array([part], pa.large_string()))[0])
        else:
            out[at:to] = own.lengths(texts.slice(at, to - at))
    return sizes, out


def token_counts(
    df: DataFrame, model_file: str, *, text: str = "text", limit: int = 4096, slice_bytes: int = SLICE_BYTES
) -> DataFrame:
    """``df`` without its text, plus n_bytes (UTF-8), n_tokens and over_limit (more tokens than ``limit``).

    ``model_file`` is a sentencepiece model that every executor finds under that path. Columns of ``df`` with the names
    of the new ones are replaced.
    """
    bounded_batches(df.sparkSession)
    new = ["n_bytes", "n_tokens", "over_limit"]
    kept = [f for f in df.schema.fields if f.name != text and f.name not in new]
    schema = T.StructType(
        [*kept, T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]
    )
    names = [f.name for f in kept]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in gathered(batches, slice_bytes):  # equal units of more texts are encoded once
            sizes, tokens = count_texts(b[text], model_file, slice_bytes)
            yield pa.RecordBatch.from_arrays(
                [*[b[c] for c in names], pa.array(sizes), pa.array(tokens), pa.array(tokens > limit)], [*names, *new]
            )

    return mapped(df.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text}`").cast("string").alias(text)), run, schema)
