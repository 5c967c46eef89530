"""Words and word hashes of whole Arrow text columns, without a Python loop over words.

A text column arrives as one contiguous UTF-8 buffer. Word boundaries, lower-casing
of A-Z and 64-bit word hashes are computed on that buffer with numpy, in groups of
documents of bounded size, so memory depends on the group and not on the column.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

_BYTES = np.arange(256)
#: White space of the word class [^\x20\x09-\x0D]+.
BLANK_WORD = ~((_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D)))
#: The word class [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z became a-z.
ALNUM_WORD = ((_BYTES >= 0x30) & (_BYTES <= 0x39)) | ((_BYTES >= 0x41) & (_BYTES <= 0x5A)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A)) | (_BYTES >= 0x80)
_LOWER = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 32, _BYTES).astype(np.uint8)

_M1, _M2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_MASKS = np.array([0] + [(1 << (8 * k)) - 1 for k in range(1, 8)] + [0xFFFFFFFFFFFFFFFF], dtype=np.uint64)
_LONG_WORD = 256


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """Words of consecutive documents: those of document i are first[i]:first[i + 1]."""

    data: np.ndarray  # bytes, with A-Z lower-cased if asked for
    start: np.ndarray  # byte position of each word
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word's bytes and length."""
        size = self.end - self.start
        h = mix(size.astype(np.uint64) + _STEP)
        if not len(h):
            return h
        padded = np.zeros(len(self.data) + 8, np.uint8)
        padded[: len(self.data)] = self.data
        eight = np.ndarray(len(self.data) + 1, "<u8", padded.data, strides=(1,))
        todo, at, left = np.arange(len(h)), self.start.copy(), size.copy()
        long = np.flatnonzero(size > _LONG_WORD)
        if len(long):
            keep = size <= _LONG_WORD
            todo, at, left = todo[keep], at[keep], left[keep]
            raw = self.data
            h[long] = [xxhash.xxh3_64_intdigest(raw[s:e].tobytes()) for s, e in zip(self.start[long], self.end[long])]
        while len(todo):
            part = eight[at] & _MASKS[np.minimum(left, 8)]
            h[todo] = mix((h[todo] ^ part) * _STEP + _M2)
            more = left > 8
            todo, at, left = todo[more], at[more] + 8, left[more] - 8
        return h

    def text(self, k: int) -> bytes:
        return self.data[self.start[k] : self.end[k]].tobytes()


def groups(column: pa.Array | pa.ChunkedArray, most: int = 2 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of groups of rows of at most `most` bytes, or of one larger row.

    A null counts as an empty text.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        hi = min(hi, len(column))
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, lower: bool = True) -> Words:
    """Maximal runs of bytes of the class `inside`; a run ends where its document ends."""
    word = inside[data]
    begin, stop = word.copy(), word.copy()
    begin[1:] &= ~word[:-1]
    stop[:-1] &= ~word[1:]
    edges = offsets[1:-1]
    edges = edges[edges < len(data)]
    begin[edges] = word[edges]  # the first byte of a document can't continue a word
    edges = edges[edges > 0]
    stop[edges - 1] = word[edges - 1]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return Words(_LOWER[data] if lower else data, start, end, np.searchsorted(start, offsets))


def rolling(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of each window of `size` consecutive hashes; empty if there are fewer."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    g = h[:n].copy()
    for k in range(1, size):
        g = g * _STEP + h[k : k + n]
        g ^= g >> np.uint64(29)
    return mix(g)


def inside_documents(first: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of the n windows of `size` words lie within one document."""
    last = np.repeat(first[1:], np.diff(first))[:n]
    return np.arange(n) + size <= last
