"""Counting keys over a whole corpus without one row per key.

Documents are dealt once into chunks of a few megabytes of text
(:func:`deal`).  A chunk reduces its keys (hashes of word windows) to the
distinct ones and sends each *bucket* of the key space one packed array
(:func:`pack`).  A bucket sums the counts of equal keys over all chunks and
answers each chunk with one byte per key it sent, in the same order
(:func:`count_buckets`); the chunk computes its keys again and reads the
answer (:func:`answer_of`).  A key that every document holds costs a chunk one
entry, so no key can make a bucket large, and nothing but these arrays moves.

The two sides are chunk and bucket numbers, both proportional to the bytes of
text, so a task's memory stays the same at every size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: text bytes a chunk should hold, and chunks that share a bucket
CHUNK_BYTES = 4 << 20
CHUNKS_PER_BUCKET = 4
#: a chunk never needs to hold more documents than this
CHUNK_ROWS = 30_000

PACKED = "bucket int, chunk int, keys binary, counts binary"
ANSWER = "chunk int, bucket int, counts binary"


@dataclass(frozen=True)
class Dealt:
    """``rows``: (_chunk, _rid, _row) in ``parts`` partitions by ``_chunk``."""
    rows: DataFrame
    chunks: int
    buckets: int
    parts: int


def deal(docs: DataFrame, text_col: str, chunk_bytes: int = CHUNK_BYTES) -> Dealt:
    """Deal documents into chunks by their row number, so that a third of all
    rows with one id, source or text still spread evenly.  ``_row`` holds the
    columns of ``docs`` as one struct, whatever their names."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(f"`{text_col}`"))), F.lit(0)).alias("b"),
                    F.count(F.lit(1)).alias("n")).first()
    chunks = max(parts, -(-size["b"] // chunk_bytes), -(-size["n"] // CHUNK_ROWS))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")) \
        .withColumn("_rid", F.monotonically_increasing_id()) \
        .withColumn("_chunk", F.pmod(F.xxhash64("_rid"), F.lit(chunks)).cast("int")) \
        .repartition(parts, "_chunk")
    return Dealt(rows, chunks, max(1, -(-chunks // CHUNKS_PER_BUCKET)), parts)


def column(table: pa.Table, name: str) -> pa.Array:
    """A field of ``_row`` as one array."""
    rows = table["_row"].combine_chunks()
    if isinstance(rows, pa.ChunkedArray):
        rows = pa.concat_arrays(rows.chunks) if rows.num_chunks else pa.array([], table["_row"].type)
    return rows.flatten()[rows.type.get_field_index(name)]


@dataclass
class Keys:
    """Distinct keys in order, their counts, and where each bucket begins.
    ``high`` orders the keys; ``low`` (or None) makes them 96 bits wide."""
    high: np.ndarray
    low: np.ndarray | None
    counts: np.ndarray
    inverse: np.ndarray
    bounds: np.ndarray


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def distinct(h: np.ndarray, buckets: int, low: np.ndarray | None = None) -> Keys:
    """Without ``low`` a key is its bucket and its last 32 bits (enough for a
    filter that a later exact step checks)."""
    if low is None:
        code = (_bucket(h, buckets) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))
        order = np.argsort(code, kind="stable")
        s = code[order]
        new = np.ones(len(s), bool)
        new[1:] = s[1:] != s[:-1]
        lows = None
    else:
        order = np.lexsort((low, h))
        s, t = h[order], low[order]
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1]) | (t[1:] != t[:-1])
        lows = t[new]
    inverse = np.empty(len(s), np.int64)
    inverse[order] = np.cumsum(new) - 1
    at = np.flatnonzero(new)
    high = s[new]
    of = (high >> np.uint64(32)) if low is None else _bucket(high, buckets)
    bounds = np.searchsorted(of, np.arange(buckets + 1, dtype=np.uint64))
    return Keys(high, lows, np.diff(np.append(at, len(s))), inverse, bounds)


def pack(chunk: int, keys: Keys, extra: bytes | None = None) -> pa.Table:
    """Rows of ``PACKED``, one for each bucket that has keys.  ``extra`` is a
    note of the chunk to itself: it comes back in the answer as bucket -1."""
    wide = keys.low is not None
    counts = np.minimum(keys.counts, 255).astype(np.uint8)
    bucket, blob, count = [], [], []
    for k in np.flatnonzero(np.diff(keys.bounds)):
        a, b = keys.bounds[k], keys.bounds[k + 1]
        bucket.append(int(k))
        blob.append(keys.high[a:b].tobytes() + keys.low[a:b].tobytes() if wide
                    else keys.high[a:b].astype(np.uint32).tobytes())
        count.append(counts[a:b].tobytes())
    if extra is not None:
        bucket.append(chunk % max(1, len(keys.bounds) - 1))
        blob.append(None)
        count.append(extra)
    n = len(bucket)
    return pa.table({"bucket": pa.array(bucket, pa.int32()), "chunk": pa.array([chunk] * n, pa.int32()),
                     "keys": pa.array(blob, pa.binary()), "counts": pa.array(count, pa.binary())})


def _sum_bucket(wide: bool):
    def run(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        chunk, keys, counts = (table[c].to_pylist() for c in ("chunk", "keys", "counts"))
        asked = [k for k in range(len(chunk)) if keys[k] is not None]
        out = [(chunk[k], -1, counts[k]) for k in range(len(chunk)) if keys[k] is None]
        if asked:
            n = np.array([len(counts[k]) for k in asked])
            c = np.frombuffer(b"".join(counts[k] for k in asked), np.uint8)
            if wide:
                high = np.concatenate([np.frombuffer(keys[k], np.uint64, len(counts[k])) for k in asked])
                low = np.concatenate([np.frombuffer(keys[k], np.uint32, len(counts[k]), 8 * len(counts[k]))
                                      for k in asked])
                order = np.lexsort((low, high))
                s, t = high[order], low[order]
                new = np.ones(len(s), bool)
                new[1:] = (s[1:] != s[:-1]) | (t[1:] != t[:-1])
            else:
                low = np.frombuffer(b"".join(keys[k] for k in asked), np.uint32)
                order = np.argsort(low, kind="stable")
                s = low[order]
                new = np.ones(len(s), bool)
                new[1:] = s[1:] != s[:-1]
            at = np.flatnonzero(new)
            total = np.add.reduceat(c[order].astype(np.int64), at)
            level = np.floor(np.log2(total)).astype(np.uint8)
            back = np.empty(len(s), np.uint8)
            back[order] = np.repeat(level, np.diff(np.append(at, len(s))))
            ends = np.cumsum(n)
            out += [(chunk[k], bucket, back[e - m:e].tobytes()) for k, m, e in zip(asked, n, ends)]
        return pa.table({"chunk": pa.array([x[0] for x in out], pa.int32()),
                         "bucket": pa.array([x[1] for x in out], pa.int32()),
                         "counts": pa.array([x[2] for x in out], pa.binary())})
    return run


def count_buckets(packed: DataFrame, dealt: Dealt, wide: bool = False) -> DataFrame:
    """Answers, dealt like the documents: floor(log2(count over all chunks))
    of every key, so 0 says that the key occurs once in the whole corpus."""
    return packed.groupBy("bucket").applyInArrow(_sum_bucket(wide), ANSWER) \
        .withColumnRenamed("chunk", "_chunk").repartition(dealt.parts, "_chunk")


def answer_of(table: pa.Table) -> tuple[np.ndarray, bytes | None]:
    """(level of every distinct key of the chunk in order, its note)."""
    got = sorted(zip(table["bucket"].to_pylist(), table["counts"].to_pylist()), key=lambda x: x[0])
    extra = next((c for k, c in got if k == -1), None)
    return np.frombuffer(b"".join(c for k, c in got if k >= 0), np.uint8), extra
