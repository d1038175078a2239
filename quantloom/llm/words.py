"""Words and word windows of whole Arrow string columns, in numpy.

A column is handled in slices of a few MB, so a task's memory is bounded by the
slice size or by its longest single text. Hashes are 64 bits: a polynomial over
a window modulo 2**64, taken from prefix sums and mixed afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SLICE_BYTES = 2 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: Separators of alphanumeric words: all of ASCII but digits and letters.
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[:0x30] = NOT_ALNUM[0x3A:0x41] = NOT_ALNUM[0x5B:0x61] = NOT_ALNUM[0x7B:0x80] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SAME = np.arange(256, dtype=np.uint8)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (splitmix64)."""
    h = h ^ (h >> U64(30))
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * U64(0x9E3779B97F4A7C15))
_BASE, _WBASE = 0x5851F42D4C957F2D, 0xD1342543DE82EF95
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n at least."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        n = max(n, 1 << 16)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
        _powers[base] = have = tuple(out)
        if n > 16 << 20:  # one huge text: do not keep its table
            _powers.pop(base)
    return have


def _ranges(values: np.ndarray, base: int, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hash of values[first:last] for each pair."""
    p, inv = powers(base, len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * p[: len(values)], out=total[1:])
    return (total[last] - total[first]) * inv[first]


@dataclass
class Words:
    """Words of the texts of one slice: text i has words offs[i]:offs[i+1]."""

    data: np.ndarray  # bytes, folded
    text_offs: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    offs: np.ndarray
    first: int  # index of the slice's first text in the column

    @property
    def n_texts(self) -> int:
        return len(self.offs) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offs)

    def hashes(self) -> np.ndarray:
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        h = _ranges(_BYTES[self.data], _BASE, self.starts, self.ends)
        return mix(h + (self.ends - self.starts).astype(np.uint64) * U64(0x9E3779B97F4A7C15))

    def text_of(self) -> np.ndarray:
        """The slice's text index of each word."""
        return np.repeat(np.arange(self.n_texts), self.counts)


def windows(h: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the first words of all k-word windows inside one text, and the windows' hashes."""
    n = np.diff(offs)
    room = np.repeat(offs[1:], n) - np.arange(len(h))  # words from here to the text's end
    pos = np.flatnonzero(room >= k)
    if not len(pos):
        return pos, np.zeros(0, np.uint64)
    return pos, mix(_ranges(h, _WBASE, pos, pos + k) + U64(k))


def range_hashes(h: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of the word ranges first:last."""
    return mix(_ranges(h, _WBASE, first, last) + (last - first).astype(np.uint64))


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each k-word shingle; a shorter, not empty text is one shingle as a whole."""
    h = words.hashes()
    pos, out = windows(h, words.offs, k)
    text = np.searchsorted(words.offs, pos, "right") - 1
    short = np.flatnonzero((words.counts > 0) & (words.counts < k))
    if len(short):
        whole = mix(_ranges(h, _WBASE, words.offs[short], words.offs[short + 1]) + words.counts[short].astype(np.uint64))
        text, out = np.concatenate([text, short]), np.concatenate([out, whole])
    return text, out


def column(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is empty."""
    if values.null_count:
        values = pc.fill_null(values, "")
    wide = pa.types.is_large_string(values.type)
    offs = np.frombuffer(values.buffers()[1], np.int64 if wide else np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64) if len(values) else np.zeros(1, np.int64)
    data = values.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offs


def slices(values: pa.Array, sep: np.ndarray = SPACE, fold: np.ndarray = SAME, max_bytes: int = SLICE_BYTES, max_texts: int = 1 << 16) -> Iterator[Words]:
    """The column's words, slice by slice; a text is never split."""
    data, offs = column(values)
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, min(n, lo + max_texts, int(np.searchsorted(offs, offs[lo] + max_bytes, "right")) - 1))
        part = data[offs[lo] : offs[hi]]
        yield tokenize(part, offs[lo : hi + 1] - offs[lo], sep, fold, lo)
        lo = hi


def tokenize(part: np.ndarray, offs: np.ndarray, sep: np.ndarray, fold: np.ndarray, first: int = 0) -> Words:
    word = ~sep[part]
    begin, end = word.copy(), word.copy()
    begin[1:] &= ~word[:-1]
    end[:-1] &= ~word[1:]
    edges = offs[:-1][offs[:-1] < offs[1:]]  # not empty texts: a word neither crosses into nor out of one
    begin[edges] = word[edges]
    edges = offs[1:][offs[:-1] < offs[1:]] - 1
    end[edges] = word[edges]
    starts = np.flatnonzero(begin)
    if fold is not SAME:
        part = fold[part]
    return Words(part, offs, starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offs), first)
