"""Texts cut into runs of bytes by a table of byte kinds, and long texts cut into portions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from textloom.llm.common import gathered
from textloom.llm.token_counts import slices
from textloom.llm.words import LOWER

INSIDE, BLANK, BREAK = 0, 1, 2


@dataclass
class Spans:
    """The runs of ``INSIDE`` bytes of some texts, one after another."""

    data: np.ndarray  # lower-cased bytes
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray  # the text that holds each run
    linked: np.ndarray  # true where the next run follows in the same text without a break
    inside: np.ndarray  # true for bytes of runs

    def strings(self) -> pa.Array:
        """The runs as binary values."""
        size = self.end - self.start
        offsets = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=offsets[1:])
        return pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(self.data[self.inside])])


def raw_texts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of texts without nulls, and where each begins."""
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    raw = texts.buffers()[2]
    raw = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def spans(texts: pa.Array, kinds: np.ndarray) -> Spans:
    """The runs of each text (large binary, no nulls). ``kinds`` has the kind of each byte, for lower-cased bytes."""
    raw, offsets = raw_texts(texts)
    data, n = LOWER[raw], len(raw)
    if not n:
        none = np.zeros(0, np.int64)
        return Spans(data, none, none, none, np.zeros(0, bool), np.zeros(0, bool))
    kind = kinds[data]
    inside = kind == INSIDE
    first = np.zeros(n, bool)
    first[offsets[:-1][offsets[:-1] < n]] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | first[1:]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | first[1:]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    doc = np.searchsorted(offsets, start, "right") - 1
    breaks = np.cumsum(kind == BREAK, dtype=np.int32)
    linked = np.zeros(len(start), bool)
    if len(start):
        linked[:-1] = (doc[1:] == doc[:-1]) & (breaks[start[1:]] == breaks[end[:-1] - 1])
    return Spans(data, start, end, doc, linked, inside)


def portions(batches: Iterator[pa.RecordBatch], text: int, kinds: np.ndarray, most: int, back: int = 0) -> Iterator[tuple[pa.RecordBatch, pa.Array, int, bool]]:
    """Texts in portions of about ``most`` bytes: the rows, their texts (large binary, null as empty), and for a text longer than that, which comes alone in several
    portions, how many runs at the portion's begin were in the one before (``back``, or fewer where the text had fewer), and if this is its last portion."""
    for b in gathered(batches, most):
        texts = pc.fill_null(b[text].cast(pa.large_binary()), b"")
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        for at, to in slices(sizes, most):
            own = texts.slice(at, to - at)
            if to > at + 1 or sizes[at] <= 2 * most:
                yield b.slice(at, to - at), own, 0, True
                continue
            raw, _ = raw_texts(own)
            for lo, hi, again in cuts(raw, kinds, most, back):
                part = pa.Array.from_buffers(pa.large_binary(), 1, [None, pa.py_buffer(np.array([0, hi - lo])), pa.py_buffer(raw[lo:hi].copy())])
                yield b.slice(at, 1), part, again, hi == len(raw)


def cuts(raw: np.ndarray, kinds: np.ndarray, most: int, back: int) -> Iterator[tuple[int, int, int]]:
    """Portions of one text: first byte, end, and the runs at the begin that the portion before had too. Cuts lie between runs."""
    at, again, done = 0, 0, 0
    while True:
        hi = min(max(done, at) + most, len(raw))
        while hi < len(raw):
            near = np.flatnonzero(kinds[LOWER[raw[hi : hi + 4096]]] != INSIDE)
            if len(near):
                hi += int(near[0]) + 1
                break
            hi = min(hi + 4096, len(raw))
        yield at, hi, again
        if hi == len(raw):
            return
        done, at, again = hi, hi, 0
        while again < back and at > 0:  # back over runs, with what parts them
            k = at
            while k > 0 and kinds[LOWER[raw[k - 1]]] != INSIDE:
                k -= 1
            if k == 0:
                break
            while k > 0 and kinds[LOWER[raw[k - 1]]] == INSIDE:
                k -= 1
            at, again = k, again + 1
