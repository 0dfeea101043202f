"""Words of many texts at once, as numpy arrays.

A word is ``[^\\x20\\x09-\\x0D]+``.  The functions work on one Arrow column of
texts (one task's batch) and never loop over words in Python: word borders
come from the UTF-8 bytes, and a word's 64-bit hash mixes its bytes eight at a
time.  Null texts have no words.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
#: words above this many bytes are hashed one by one
_LONG_WORD = 512

_M1 = np.uint64(0xFF51AFD7ED558CCD)
_M2 = np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads every bit."""
    x = x ^ (x >> _S33)
    x = x * _M1
    x ^= x >> _S33
    x *= _M2
    x ^= x >> _S33
    return x


@dataclass
class Words:
    """Words of ``n`` texts: ``buf[starts[k]:ends[k]]``; text ``d`` has the
    words ``first[d]:first[d + 1]``."""
    buf: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        """Text number of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.type != pa.large_utf8():
        column = column.cast(pa.large_utf8())
    if column.null_count:
        column = column.fill_null("")
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset:column.offset + len(column) + 1] if off is not None \
        else np.zeros(1, np.int64)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8)[off[0]:off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


def split_words(column, lower: bool = False, space: np.ndarray = SPACE) -> Words:
    """Words of every text of an Arrow column."""
    buf, offsets = text_bytes(column)
    if lower:
        buf = _LOWER[buf]
    n = len(buf)
    word = np.empty(n + 2, bool)
    word[0] = word[-1] = False
    np.logical_not(space[buf], out=word[1:-1])
    begin = word[1:-1] & ~word[:-2]
    stop = word[1:-1] & ~word[2:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < n)]
    begin[edge] = word[1:-1][edge]
    stop[edge - 1] = word[1:-1][edge - 1]
    starts = np.flatnonzero(begin)
    ends = np.flatnonzero(stop) + 1
    first = np.searchsorted(starts, offsets)
    return Words(buf, offsets, starts, ends, first)


def hash_words(w: Words, seed: int = 0) -> np.ndarray:
    """64-bit hash of each word's bytes."""
    return hash_spans(w.buf, w.starts, w.ends, seed)


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    size = ends - starts
    if not len(size):
        return np.zeros(0, np.uint64)
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[:-8] = buf
    lanes = np.ndarray((len(buf) + 1,), "<u8", padded, strides=(1,))
    h = mix(size.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1)))
    h = mix(h ^ (lanes[starts] & _MASK[np.minimum(size, 8)]))
    at = 8
    left = np.flatnonzero(size > 8)
    while len(left) and at < _LONG_WORD:
        s = size[left]
        h[left] = mix(h[left] ^ (lanes[starts[left] + at] & _MASK[np.minimum(s - at, 8)]))
        at += 8
        left = left[s > at]
    for k in left:
        d = hashlib.blake2b(buf[starts[k]:ends[k]].tobytes(), digest_size=8, salt=seed.to_bytes(8, "little")).digest()
        h[k] = np.frombuffer(d, "<u8")[0]
    return h


_BASE = 0x9E3779B97F4A7C15 | 1


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def window_hashes(h: np.ndarray, width: int, at: np.ndarray, base: int = _BASE) -> np.ndarray:
    """Rolling hash of ``h[p:p + width]`` for each p of ``at`` (all in range)."""
    n = len(h)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(h * powers(base, n), out=total[1:])
    return mix((total[at + width] - total[at]) * powers(pow(base, -1, 2**64), n + 1)[at])


def shingle_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of every ``width`` neighbours of ``h``, text borders ignored."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    x = h[:n].copy()
    for k in range(1, width):
        x *= np.uint64(_BASE)
        x += h[k:n + k]
    return mix(x)
