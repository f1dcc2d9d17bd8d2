"""Words and their 64-bit names, computed over whole Arrow batches with NumPy.

A word is a maximal run of bytes outside ``\\x20\\x09-\\x0D``, exactly as the
regular expression ``[^\\x20\\x09-\\x0D]+`` sees it.  Null texts have no words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACES = b" \t\n\x0b\x0c\r"
SLICE_BYTES = 4 << 20

_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[list(SPACES)] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=np.uint64)
_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit (splitmix finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def chained(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Name of the sequence named ``left`` followed by the item named ``right``."""
    return mixed(left * _M3 + right + _M1)


@dataclass
class Words:
    """The words of the texts of one slice, in order; ``doc`` is the row within the slice."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    first: np.ndarray  # index of the first word of each row, and the number of words at the end

    def names(self, seed: int) -> np.ndarray:
        return span_names(self.data, self.starts, self.ends, seed)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the texts of each have a few megabytes (a longer text stands alone)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), dtype=np.int64)
        part = np.cumsum(sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def find_words(texts: pa.Array, lower: bool = False, is_word: np.ndarray = _IS_WORD) -> Words:
    """Words are maximal runs of the bytes marked in ``is_word``, after A-Z are lower-cased if asked."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    if lower:
        data = _LOWER[data]
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = is_word[data]
    begin = inside[1:-1] & ~inside[:-2]
    end = inside[1:-1] & ~inside[2:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    begin[edges] |= inside[1:-1][edges]
    end[edges - 1] |= inside[1:-1][edges - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    first = np.searchsorted(starts, offsets)
    doc = np.repeat(np.arange(n), np.diff(first))
    return Words(data, starts, ends, doc, first)


def word_values(words: Words) -> pa.Array:
    """The words themselves, as one Arrow array."""
    length = words.ends - words.starts
    offsets = np.zeros(len(length) + 1, dtype=np.int64)
    np.cumsum(length, out=offsets[1:])
    at = np.arange(offsets[-1]) + np.repeat(words.starts - offsets[:-1], length)
    return pa.LargeStringArray.from_buffers(len(length), pa.py_buffer(offsets), pa.py_buffer(words.data[at].tobytes()))


def span_names(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """64-bit names of byte spans, a function of the bytes and the seed alone."""
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded.data, strides=(1,))
    length = ends - starts
    names = mixed(length.astype(np.uint64) * _M3 + np.uint64(seed))
    names = mixed(names ^ (eight[starts] & _MASKS[np.minimum(length, 8)]))
    rest, at = np.flatnonzero(length > 8), 8
    while len(rest):
        names[rest] = mixed(names[rest] * _M3 ^ (eight[starts[rest] + at] & _MASKS[np.minimum(length[rest] - at, 8)]))
        at += 8
        rest = rest[length[rest] > at]
    return names
