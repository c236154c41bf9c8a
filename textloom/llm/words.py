"""Words of whole texts as arrays: byte positions and 64-bit hashes, without a Python object for each word.

A word is a run of ASCII letters, digits and characters from U+0080 on, with A-Z lower-cased: in UTF-8 all bytes of
such characters are 0x80 or more, so runs of bytes are runs of characters.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IN_WORD = np.zeros(256, bool)
IN_WORD[48:58] = IN_WORD[97:123] = IN_WORD[128:] = True

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values under which each input bit changes about half of the output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 20)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[name] = np.cumprod(x, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


@dataclass
class Words:
    """Words of some texts one after another. Text i has the words first[i] to first[i+1]."""

    data: np.ndarray  # lower-cased bytes
    start: np.ndarray  # of each word in data
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    def text(self, i: int, j: int) -> bytes:
        """The words i to j-1, joined by blanks."""
        return b" ".join(self.data[self.start[k] : self.end[k]].tobytes() for k in range(i, j))


def words(texts: pa.Array) -> Words:
    """The words of each text; null has none."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    if texts.null_count:  # what lies under a null counts for nothing
        texts = texts.fill_null(b"")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2] if len(texts) else None
    raw = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    data = LOWER[raw]
    n = len(data)
    inside = np.zeros(n + 1, bool)
    inside[:n] = IN_WORD[data]
    cut = inside[:n].copy()  # true where a word goes on from the byte before
    cut[1:] &= inside[: n - 1] if n else False
    if n:
        cut[0] = False
        cut[offsets[:-1][offsets[:-1] < n]] = False
    start = np.flatnonzero(inside[:n] & ~cut)
    goes_on = np.zeros(n, bool)
    if n:
        goes_on[: n - 1] = cut[1:]
    end = np.flatnonzero(inside[:n] & ~goes_on) + 1
    return Words(data, start, end, np.searchsorted(start, offsets), hashes(data, start, end))


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, the same for the same bytes anywhere."""
    out = np.empty(len(start), np.uint64)
    step = 1 << 20
    at = 0
    while at < len(start):  # in pieces, so that the powers stay a short table
        base = start[at]
        to = max(at + 1, int(np.searchsorted(start, base + step)))
        piece = data[base : end[to - 1]].astype(np.uint64) + np.uint64(1)
        up, down = powers(len(piece) + 1)
        total = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(piece * up[: len(piece)], dtype=np.uint64, out=total[1:])
        a, b = start[at:to] - base, end[at:to] - base
        out[at:to] = (total[b] - total[a]) * down[a] + (b - a).astype(np.uint64)
        at = to
    return mix(out)


def windows(w: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words inside one text; the first word of each; first index of each text's runs."""
    n = len(w.hash) - size + 1
    count = np.maximum(np.diff(w.first) - size + 1, 0)
    first = np.concatenate(([0], np.cumsum(count)))
    if n <= 0 or not first[-1]:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), first
    h = w.hash[:n].copy()
    for k in range(1, size):
        h *= _BASE
        h += w.hash[k : n + k]
    at = np.repeat(w.first[:-1] - first[:-1], count) + np.arange(first[-1])
    return mix(h[at]), at, first
