"""Substring dedup by difference-cover anchors (operator 1).

Every window of ``width`` words whose sequence also starts at another place
(in any document, the same one included) is a repeat; every word that a
repeat covers is removed.  Windows are judged on the input.

Positions of a document are numbered from 0 and taken modulo ``period``; a
difference cover is a set of remainders such that any two positions, moved on
by one common step below ``period``, both land in it.  So if the same
``width`` words start at i and j, some step d < period makes i + d and j + d
anchors, and the ``width - period + 1`` words there are equal.  Three passes:

1. each anchor's short window is hashed, and the corpus counts the hashes
   (about ``sqrt(1.5 period) / period`` of all positions are sent, 4 bytes each);
2. anchors that occur twice extend: each ``width``-word window that an anchor
   lies in is a candidate, and its whole fingerprint (96 bits) is counted;
3. candidates counted twice are repeats; their words are removed.

No pairs are formed, so a passage in a third of all documents costs what any
other does.  Nulls, empty texts and texts under ``width`` words keep all their
words; a word of any length is one word; rows that repeat (ids included) are
rows like others, so both copies go; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import exchange as X
from .words import Words, hash_words, split_words, window_hashes

WIDTH = 35
PERIOD = 21
_SECOND = 0xD6E8FEB86659FD93


@lru_cache
def difference_cover(period: int) -> tuple[int, ...]:
    """The first smallest set of remainders whose differences are all remainders."""
    for size in range(1, period + 1):
        for rest in itertools.combinations(range(1, period), size - 1):
            cover = (0, *rest)
            if len({(a - b) % period for a in cover for b in cover}) == period:
                return cover
    raise ValueError("period must be at least 1")


def _places(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Place of each word in its text, and words from there to the text's end."""
    counts = w.counts
    place = np.arange(len(w.starts)) - np.repeat(w.first[:-1], counts)
    return place, np.repeat(counts, counts) - place


def _anchors(h: np.ndarray, w: Words, width: int, period: int) -> tuple[np.ndarray, np.ndarray]:
    place, left = _places(w)
    short = width - period + 1
    hit = np.zeros(period, bool)
    hit[list(difference_cover(period))] = True
    at = np.flatnonzero(hit[place % period] & (left >= short) & (place + left >= width))
    return at, window_hashes(h, short, at)


def _candidates(h: np.ndarray, w: Words, width: int, period: int, at: np.ndarray, twice: np.ndarray) -> np.ndarray:
    """Starts of the windows that hold a repeated anchor."""
    seen = np.zeros(len(h) + 1, np.int32)
    seen[at[twice] + 1] = 1
    seen = np.cumsum(seen)
    _, left = _places(w)
    start = np.flatnonzero(left >= width)
    return start[seen[start + period] > seen[start]]


def _windows(h: np.ndarray, width: int, start: np.ndarray, buckets: int) -> X.Keys:
    return X.distinct(window_hashes(h, width, start), buckets,
                      (window_hashes(h, width, start, _SECOND) & np.uint64(0xFFFFFFFF)).astype(np.uint32))


def _read(table: pa.Table, text_col: str) -> tuple[pa.Table, Words, np.ndarray]:
    table = table.sort_by("_rid")
    w = split_words(X.column(table, text_col))
    return table, w, hash_words(w)


def keep_words(w: Words, keep: np.ndarray) -> pa.Array:
    """Texts made of the kept words, joined by one space."""
    n = len(w.buf)
    out = w.buf.copy()
    step = np.zeros(n + 1, np.int8)
    step[w.starts[keep]] = 1
    np.subtract.at(step, w.ends[keep], 1)
    mask = np.cumsum(step[:-1], dtype=np.int8).astype(bool)
    kept = np.flatnonzero(keep)
    doc = w.doc()[kept]
    joint = w.ends[kept[:-1][doc[:-1] == doc[1:]]]
    out[joint] = 32
    mask[joint] = True
    size = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])[w.offsets]
    return pa.Array.from_buffers(pa.large_utf8(), len(w.offsets) - 1,
                                 [None, pa.py_buffer(size.astype(np.int64)), pa.py_buffer(out[mask])]) \
        .cast(pa.utf8())


def remove_repeats(docs: DataFrame, text_col: str = "text", width: int = WIDTH, period: int = PERIOD,
                   chunk_bytes: int = X.CHUNK_BYTES) -> DataFrame:
    """``docs`` with ``text_col`` cut to the kept words, joined by one space
    (null stays null), and ``n_words`` and ``n_removed``.  Columns of these two
    names are replaced."""
    if not 1 <= period <= width:
        raise ValueError("period must lie between 1 and width")
    dealt = X.deal(docs, text_col, chunk_bytes)
    buckets = dealt.buckets

    def anchors(table: pa.Table) -> pa.Table:
        chunk = table["_chunk"][0].as_py()
        _, w, h = _read(table, text_col)
        return X.pack(chunk, X.distinct(_anchors(h, w, width, period)[1], buckets))

    def extend(table: pa.Table, answer: pa.Table) -> pa.Table:
        chunk = table["_chunk"][0].as_py()
        _, w, h = _read(table, text_col)
        at, key = _anchors(h, w, width, period)
        twice = (X.answer_of(answer)[0] > 0)[X.distinct(key, buckets).inverse]
        start = _candidates(h, w, width, period, at, twice)
        return X.pack(chunk, _windows(h, width, start, buckets), np.packbits(twice).tobytes())

    def cut(table: pa.Table, answer: pa.Table) -> pa.Table:
        table, w, h = _read(table, text_col)
        level, note = X.answer_of(answer)
        place, left = _places(w)
        at = _anchors(h, w, width, period)[0]
        twice = np.unpackbits(np.frombuffer(note, np.uint8))[:len(at)].astype(bool)
        start = _candidates(h, w, width, period, at, twice)
        again = start[(level > 0)[_windows(h, width, start, buckets).inverse]]
        step = np.zeros(len(h) + 1, np.int32)
        step[again] += 1
        step[again + width] -= 1
        keep = np.cumsum(step[:-1]) == 0
        gone = np.concatenate([[0], np.cumsum(~keep)])
        text = X.column(table, text_col)
        kept = keep_words(w, keep)
        if text.null_count:
            kept = pc.if_else(text.is_null(), pa.scalar(None, pa.utf8()), kept)
        return pa.table({"_row": table["_row"], "_kept": kept,
                         "_words": pa.array(w.counts, pa.int64()),
                         "_gone": pa.array(gone[w.first[1:]] - gone[w.first[:-1]], pa.int64())})

    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")).schema["_row"]
    schema = T.StructType([row, T.StructField("_kept", T.StringType()), T.StructField("_words", T.LongType()),
                           T.StructField("_gone", T.LongType())])
    groups = dealt.rows.groupBy("_chunk")
    found = X.count_buckets(groups.applyInArrow(anchors, X.PACKED), dealt)
    whole = X.count_buckets(groups.cogroup(found.groupBy("_chunk")).applyInArrow(extend, X.PACKED), dealt, wide=True)
    out = groups.cogroup(whole.groupBy("_chunk")).applyInArrow(cut, schema)
    same = [c for c in docs.columns if c not in ("n_words", "n_removed")]
    return out.select(*[(F.col("_kept") if c == text_col else F.col("_row").getField(c)).alias(c) for c in same],
                      F.col("_words").alias("n_words"), F.col("_gone").alias("n_removed"))


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """One row per document: words, words removed, digest of what is left."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select(
        "doc_id", "n_words", "n_removed",
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
