"""Hashed features of many texts at once, and bounded training samples."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import SPACE, Words, hash_spans, hash_words, mix, split_words

#: an upper-case letter of Latin-1 is C3 80..9E in UTF-8, its lower case 0x20 more
_LATIN1 = np.uint8(0xC3)


@dataclass
class Vocabulary:
    """Distinct words of a batch: word k is ``buf[starts[k]:ends[k]]`` with
    hash ``keys[k]``; ``which`` is the distinct word of each word of ``words``."""
    words: Words
    starts: np.ndarray
    ends: np.ndarray
    keys: np.ndarray
    which: np.ndarray

    def per_doc(self) -> tuple[np.ndarray, np.ndarray]:
        """(doc, distinct word) of each text, every one once, by doc."""
        n = max(1, len(self.keys))
        pair = np.unique(self.words.doc() * n + self.which)
        return pair // n, pair % n


def lower_words(column, space: np.ndarray = SPACE) -> Words:
    """Words in lower case (A-Z and the upper-case letters of Latin-1)."""
    w = split_words(column, lower=True, space=space)
    buf = w.buf
    lead = np.flatnonzero(buf[:-1] == _LATIN1) + 1
    up = lead[(buf[lead] >= 0x80) & (buf[lead] <= 0x9E) & (buf[lead] != 0x97)]
    if len(up):
        buf = buf.copy()
        buf[up] += 0x20
        w.buf = buf
    return w


def vocabulary(column) -> Vocabulary:
    w = lower_words(column)
    h = hash_words(w)
    order = np.argsort(h, kind="stable")
    s = h[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    which = np.empty(len(h), np.int64)
    which[order] = np.cumsum(new) - 1
    one = order[new]
    return Vocabulary(w, w.starts[one], w.ends[one], s[new], which)


def byte_ngrams(v: Vocabulary, sizes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(distinct word, hash) of the n-grams of bytes of each distinct word,
    with one border byte before and after it; sizes up to 8."""
    size = v.ends - v.starts
    begin = np.concatenate([[0], np.cumsum(size + 2)])
    text = np.full(int(begin[-1]), 0x20, np.uint8)
    k = np.arange(int(size.sum()))
    shift = np.repeat(np.cumsum(size) - size, size)
    text[k - shift + np.repeat(begin[:-1] + 1, size)] = v.words.buf[k - shift + np.repeat(v.starts, size)]
    owner = np.repeat(np.arange(len(size)), size + 2)
    stop = begin[owner + 1] if len(owner) else owner
    at = np.arange(len(text))
    owners, hashes = [], []
    for n in sizes:
        here = np.flatnonzero(at + n <= stop)
        owners.append(owner[here])
        hashes.append(hash_spans(text, here, here + n, seed=n))
    return np.concatenate(owners), np.concatenate(hashes)


def fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null ids fall into none (null)."""
    return F.crc32(id_col.cast("string").cast("binary")) % folds


def first_rows(rows: DataFrame, id_col: str, most: int, salt: int) -> DataFrame:
    """At most ``most`` rows of ``rows``, chosen by a hash of the id."""
    return rows.orderBy(F.xxhash64(F.col(id_col), F.lit(salt)), id_col).limit(most)


def unpack(blobs, dtype) -> tuple[np.ndarray, np.ndarray]:
    """(all numbers, where each blob begins)."""
    flat = np.frombuffer(b"".join(blobs), dtype)
    size = np.array([len(x) for x in blobs], np.int64) // np.dtype(dtype).itemsize
    return flat, np.concatenate([[0], np.cumsum(size)])


def segment_sum(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values[first[k]:first[k + 1]]``; works on columns too."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), np.float64)
    np.cumsum(values, axis=0, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def bins(h: np.ndarray, bits: int) -> np.ndarray:
    return (mix(h) >> np.uint64(64 - bits)).astype(np.int64)

