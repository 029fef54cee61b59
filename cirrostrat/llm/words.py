"""Vectorised tokenising and hashing of Arrow string columns with numpy.

Works on the UTF-8 bytes of many texts at once. Word patterns of the operators
are byte classes, as every byte of a non-ASCII character is a word byte, so
cutting bytes cuts exactly as the regular expression on characters does.

Hashes are polynomial (modulo 2**64) with a finishing mix. They choose
candidates; operators that look for phrases compare the real words afterwards
(sets of n-grams are compared as sets of hashes).
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: About so many bytes of text are in numpy form at once (32 bytes of scratch for each); one longer text goes alone.
SLICE_BYTES = 1 << 20

_UPPER = np.arange(256, dtype=np.uint8)
_UPPER[65:91] += 32


def _table(is_word) -> np.ndarray:
    """Byte translation: A-Z lower-cased, bytes outside words to blank."""
    out = _UPPER.copy()
    for b in range(256):
        if not is_word(out[b]):
            out[b] = 32
    return out


#: Words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z.
ALNUM = _table(lambda b: 48 <= b <= 57 or 97 <= b <= 122 or b >= 128)
#: Words ``[^\x20\x09-\x0D]+`` after lower-casing A-Z.
BLANKS = _table(lambda b: b != 32 and not 9 <= b <= 13)

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_PINV = np.uint64(pow(int(_P), -1, 1 << 64))
_Q = np.uint64(0xC2B2AE3D27D4EB4F)


def mix(h: np.ndarray) -> np.ndarray:
    """Finishing step of a 64-bit hash (shift, multiply, shift)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Powers:
    """Powers of the hash base and of its inverse, grown when a longer text comes."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, 2 * len(self.up))
            one = np.ones(size, np.uint64)
            up, down = one * _P, one * _PINV
            up[0] = down[0] = 1
            self.up, self.down = np.cumprod(up), np.cumprod(down)
        return self.up, self.down


@dataclass
class Words:
    """Words of the texts of one slice, in order."""

    data: np.ndarray  # translated bytes of all texts, a blank after each
    start: np.ndarray  # of each word, in data
    end: np.ndarray
    first: np.ndarray  # of each text, the index of its first word; one more at the end

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, powers: Powers) -> np.ndarray:
        up, down = powers.upto(len(self.data) + 1)
        total = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up[: len(self.data)], out=total[1:])
        h = (total[self.end] - total[self.start]) * down[self.start]
        return mix(h + (self.end - self.start).astype(np.uint64) * _Q)

    def text(self, word: int, k: int) -> bytes:
        """k words from that one, joined by one blank."""
        return b" ".join(self.data[self.start[word] : self.end[word + k - 1]].tobytes().split())

    def joined(self) -> tuple[bytes, np.ndarray]:
        """All words with one blank after each, and where each begins there (and the end)."""
        keep = self.data != 32
        keep[self.end] = True  # the blank after a word
        at = np.zeros(len(self.start) + 1, np.int64)
        np.cumsum(self.end - self.start + 1, out=at[1:])
        return self.data[keep].tobytes(), at

    def room(self) -> np.ndarray:
        """For each word, the words from it to the end of its text."""
        n = len(self.start)
        return np.repeat(self.first[1:], self.counts()) - np.arange(n)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive entries, for each place where k are left in h."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    for j in range(1, k):
        out *= _Q
        out += h[j : j + n]
    return mix(out + np.uint64(k))


def cut(texts: list[bytes] | tuple[np.ndarray, np.ndarray], table: np.ndarray) -> Words:
    """texts: byte strings, or (bytes, offsets) as Arrow has them."""
    if isinstance(texts, list):
        offsets = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) for t in texts], out=offsets[1:])
        raw = np.frombuffer(b"".join(texts), np.uint8)
    else:
        raw, offsets = texts
    n = len(offsets) - 1
    lengths = np.diff(offsets)
    data = np.full(len(raw) + n, 32, np.uint8)  # a blank after each text keeps words apart
    if len(raw):
        data[np.arange(len(raw)) + np.repeat(np.arange(n), lengths)] = table[raw]
    word = np.empty(len(data) + 1, bool)
    word[0] = False
    np.not_equal(data, 32, out=word[1:])
    edge = np.flatnonzero(word[1:] != word[:-1])
    start, end = edge[::2], edge[1::2]
    first = np.searchsorted(start, np.append(offsets[:-1] + np.arange(n), len(data)))
    return Words(data, start, end, first)


def give_back() -> None:
    """Returns freed scratch memory to the system: workers stay alive between tasks, and the C library keeps it else."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def utf8(column: pa.Array) -> pa.LargeStringArray:
    """The column as text, nulls as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_string()).fill_null("")


def raw_bytes(column: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the texts and the offsets in them, from 0."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, text: str = "text", most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.LargeStringArray]]:
    """The batch in runs of rows of about that many bytes of text, with their texts."""
    column = utf8(batch.column(text))
    _, at = raw_bytes(column)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, side="right")) - 1)
        yield batch.slice(lo, hi - lo), column.slice(lo, hi - lo)
        lo = hi
    if len(column):
        give_back()
