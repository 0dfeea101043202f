"""Benchmark decontamination by greedy string tiling (operator 6).

Words are compared in lower case and without ASCII punctuation; in scripts
written without spaces every character is a word.  Documents and benchmark items
are joined on shared *seeds* (``MIN_MATCH`` neighbouring words); for each pair
that shares enough of them, greedy string tiling covers the item with tiles, runs
of at least ``MIN_MATCH`` words that also stand in the document: search lengths
fall from long to short, running Karp-Rabin hashes find the unmarked matches of
that length or more, and the longest of what is still unmarked is marked on both
sides until none is left.  An item leaks into a document if tiles cover at least
``COVERAGE`` of its words, in whatever order.

An item of fewer than ``MIN_MATCH`` words is one seed, and leaks where all its
words stand in a row.

Seeds of a benchmark up to ``BROADCAST_SEEDS`` go to every task; a larger one
is joined by a shuffle of the documents' seeds, less those that a Bloom filter of
the items' seeds (``FILTER_BITS`` bits) rules out; the result is the same, in the
same order.  Seeds that occur in a third of all documents cost each document one
look-up.

Null and empty texts and items, and items without a word, match nothing.  Items
and documents that repeat match each; null ids are kept.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .features import lower_words
from .packing import slices
from .words import Words, hash_words, shingle_hashes, window_hashes

MIN_MATCH = 5
COVERAGE = 0.6
BROADCAST_SEEDS = 2_000_000
FIRST_LENGTH = 20
FILTER_BITS = 27

_APART = np.ones(256, bool)
for _a, _b in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    _APART[_a:_b] = False

LEAK = "struct<item_id:{0},item_words:int,tiled_words:int,tiles:int,coverage:double>"


def _matches(a: np.ndarray, b: np.ndarray, free_a: np.ndarray, free_b: np.ndarray, size: int) -> tuple:
    """(begins in a, begins in b, lengths) of the maximal unmarked matches of at
    least ``size`` words.  A match begins where equal windows have unequal (or
    no) windows before them, and ends where the same holds behind."""
    def windows(h, free):
        taken = np.concatenate([[0], np.cumsum(~free)])
        at = np.flatnonzero(taken[size:] == taken[:-size]) if len(h) >= size else np.zeros(0, np.int64)
        return at, window_hashes(h, size, at)

    at_a, key_a = windows(a, free_a)
    at_b, key_b = windows(b, free_b)
    names, rank = np.unique(np.concatenate([key_a, key_b]), return_inverse=True)
    base = len(names) + 1
    all_a, all_b = np.zeros(len(a) + 2, np.int64), np.zeros(len(b) + 2, np.int64)  # 0: no window here
    all_a[at_a + 1], all_b[at_b + 1] = rank[:len(at_a)] + 1, rank[len(at_a):] + 1

    def edges(side: int):
        """Pairs of equal windows whose neighbours on this side are not equal."""
        mine, near = all_b[at_b + 1] * base, all_b[at_b + 1 + side]
        order = np.argsort(mine + near, kind="stable")
        sorted_b = (mine + near)[order]
        key, beside = all_a[at_a + 1] * base, all_a[at_a + 1 + side]
        low, high = np.searchsorted(sorted_b, key), np.searchsorted(sorted_b, key + base)
        skip = np.where(beside > 0, np.searchsorted(sorted_b, key + beside), high)
        on = np.where(beside > 0, np.searchsorted(sorted_b, key + beside, "right"), high)
        begin, count = np.concatenate([low, on]), np.concatenate([skip - low, high - on])
        i = np.repeat(np.concatenate([at_a, at_a]), count)
        j = at_b[order[np.arange(len(i)) - np.repeat(np.cumsum(count) - count - begin, count)]]
        by = np.lexsort((i, i - j))
        return i[by], j[by]

    i, j = edges(-1)
    return i, j, edges(1)[0] - i + size


def tile(a: np.ndarray, b: np.ndarray, least: int = MIN_MATCH, first: int = FIRST_LENGTH) -> list[tuple[int, int, int]]:
    """Greedy string tiles (begin in a, begin in b, length) of two sequences of
    word hashes: the longest unmarked match again and again, ties to the first
    in a, then in b."""
    free_a, free_b = np.ones(len(a), bool), np.ones(len(b), bool)
    tiles: list[tuple[int, int, int]] = []
    length = max(least, min(first, len(a), len(b)))
    while True:
        i, j, n = _matches(a, b, free_a, free_b, length)
        queue = list(zip((-n).tolist(), i.tolist(), j.tolist()))
        heapq.heapify(queue)
        while queue and free_b.any():
            n, i, j = heapq.heappop(queue)
            n = -n
            open_ = free_a[i:i + n] & free_b[j:j + n] & (a[i:i + n] == b[j:j + n])
            if open_.all():
                free_a[i:i + n] = False
                free_b[j:j + n] = False
                tiles.append((i, j, n))
                continue
            edge = np.flatnonzero(np.diff(np.concatenate([[False], open_, [False]]).astype(np.int8)))
            for x, y in zip(edge[::2].tolist(), edge[1::2].tolist()):
                if y - x >= length:
                    heapq.heappush(queue, (x - y, i + x, j + x))
        if length == least or not free_b.any():
            return tiles
        length = max(least, length // 2)


class Items:
    """Benchmark items and an index of their seeds, one for each size of seed."""

    def __init__(self, ids: list, words: list[np.ndarray], least: int):
        self.ids, self.words = ids, words
        self.index = {}
        size = np.array([min(least, len(w)) for w in words], np.int64)
        for s in np.unique(size[size > 0]).tolist():
            mine = np.flatnonzero(size == s)
            seeds = [shingle_hashes(words[k], s) for k in mine]
            n = np.array([len(x) for x in seeds], np.int64)
            flat = np.concatenate(seeds)
            order = np.argsort(flat, kind="stable")
            at = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
            self.index[s] = flat[order], np.repeat(mine, n)[order], at[order]

    def leaks(self, h: np.ndarray, size: int, hits: np.ndarray, coverage: float) -> list[tuple]:
        """Leaks of items with seeds of ``size`` words into one document with
        word hashes ``h``, whose seeds at ``hits`` occur in the benchmark."""
        seeds, item_of, place = self.index[size]
        keys = shingle_hashes(h, size)[hits]
        low, high = np.searchsorted(seeds, keys), np.searchsorted(seeds, keys, "right")
        n = high - low
        k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n - low, n)
        item, at, of = item_of[k], place[k], np.repeat(hits, n)
        order = np.argsort(item, kind="stable")
        item, at, of = item[order], at[order], of[order]
        each, begin = np.unique(item, return_index=True)
        out = []
        for it, x, y in zip(each.tolist(), begin.tolist(), [*begin[1:].tolist(), len(item)]):
            words = self.words[it]
            need = coverage * len(words) - 1e-9
            if _covered(at[x:y], size, len(words)).sum() < need:
                continue  # tiles lie within shared seeds
            use = _covered(of[x:y], size, len(h))
            gap = np.flatnonzero(use[1:] & ~use[:-1])
            a = h.copy()
            a[gap] = 0  # a word of no item between the parts
            use[gap] = True
            tiles = tile(a[use], words, size)
            tiled = sum(t[2] for t in tiles)
            if tiled >= need:
                out.append((self.ids[it], len(words), tiled, len(tiles), tiled / len(words)))
        return out

    def all_leaks(self, h: np.ndarray, first: np.ndarray, coverage: float) -> list[list[dict]]:
        """Leaks into each of many texts, in the order of Spark's ``sort_array``."""
        out = [[] for _ in range(len(first) - 1)]
        for size, (seeds, _, _) in self.index.items():
            for doc, hits in _hits(h, first, seeds, size):
                out[doc] += self.leaks(h[first[doc]:first[doc + 1]], size, hits, coverage)
        return [[dict(zip(_NAMES, x)) for x in sorted(some, key=lambda x: (x[0] is not None, *x) if x[0] is not None
                                                      else (False, 0, *x[1:]))] for some in out]


def _covered(at: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of ``n`` words lie in a window of ``size`` words that begins at ``at``."""
    part = np.zeros(n + 1, np.int64)
    np.add.at(part, at, 1)
    np.add.at(part, at + size, -1)
    return np.cumsum(part[:-1]) > 0


# First and last code points of scripts written without spaces
# (Thai and Lao, Myanmar, Khmer, kana, Han).
_UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x4DBF),
             (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF))


def _split_unspaced(w: Words) -> Words:
    """Words cut before and behind every character of the scripts above."""
    buf = np.concatenate([w.buf, np.zeros(4, np.uint8)])
    at = np.flatnonzero(w.buf >= 0xE0)
    if not len(at):
        return w
    a, b, c, d = (buf[at + k].astype(np.int64) for k in range(4))
    wide = a >= 0xF0
    point = np.where(wide, (a & 0x07) << 18 | (b & 0x3F) << 12 | (c & 0x3F) << 6 | d & 0x3F,
                     (a & 0x0F) << 12 | (b & 0x3F) << 6 | c & 0x3F)
    alone = np.zeros(len(at), bool)
    for low, high in _UNSPACED:
        alone |= (point >= low) & (point <= high)
    at, stop = at[alone], at[alone] + np.where(wide[alone], 4, 3)
    if not len(at):
        return w
    begin = np.zeros(len(buf) + 1, bool)
    end = np.zeros(len(buf) + 1, bool)
    begin[w.starts], end[w.ends] = True, True
    inside = np.zeros(len(buf) + 1, np.int32)
    np.add.at(inside, w.starts, 1)
    np.add.at(inside, w.ends, -1)
    inside = np.cumsum(inside) > 0
    for cut in (at, stop):  # a cut within a word ends one and begins another
        here = cut[inside[cut] & ~begin[cut]]
        begin[here] = end[here] = True
    starts = np.flatnonzero(begin)
    return Words(w.buf, w.offsets, starts, np.flatnonzero(end), np.searchsorted(starts, w.offsets))


def word_hashes(column) -> tuple[np.ndarray, np.ndarray]:
    w = _split_unspaced(lower_words(column, _APART))
    h = hash_words(w)
    h[h == 0] = 1
    return h, w.first


def _item_words(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, words): hashes of the words of every item that has any."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, first = word_hashes(batch.column("text"))
            keep = np.flatnonzero(np.diff(first))
            yield pa.RecordBatch.from_arrays(
                [batch.column("item").take(pa.array(keep)),
                 pa.array([h[first[k]:first[k + 1]].tobytes() for k in keep.tolist()], pa.binary())], ["item", "words"])
    rows = benchmark.select(F.col(f"`{id_col}`").alias("item"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"item {rows.schema['item'].dataType.simpleString()}, words binary")


def find_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
               item_text_col: str = "text", least: int = MIN_MATCH, coverage: float = COVERAGE,
               broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """``docs`` with ``leaks``: the items that leak into each.  A column of
    that name is replaced."""
    docs = docs.drop("leaks")
    kind = f"array<{LEAK.format(benchmark.schema[item_col].dataType.simpleString())}>"
    items = materialize(_item_words(benchmark, item_col, item_text_col), "items")
    size = items.agg(F.coalesce(F.sum(F.length("words") / 8), F.lit(0)).alias("n")).first()["n"]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
                       F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"))
    if size > broadcast_seeds:
        return _by_join(docs, rows, items, kind, least, coverage)
    known = [(r["item"], bytes(r["words"])) for r in items.collect()]  # at most broadcast_seeds words
    shared = docs.sparkSession.sparkContext.broadcast(
        Items([r[0] for r in known], [np.frombuffer(r[1], np.uint64) for r in known], least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = shared.value
        for batch in batches:
            for part in slices(batch, "_text"):
                out = bench.all_leaks(*word_hashes(part.column("_text")), coverage)
                yield pa.RecordBatch.from_arrays([part.column("_row"), pa.array(out, leak_type)], ["_row", "leaks"])

    schema = rows.select("_row", F.array().cast(kind).alias("leaks")).schema
    leak_type = _arrow(schema["leaks"].dataType)
    return rows.mapInArrow(run, schema) \
        .select(*[F.col("_row").getField(c).alias(c) for c in docs.columns], "leaks")


_NAMES = ("item_id", "item_words", "tiled_words", "tiles", "coverage")


def _arrow(kind):
    from pyspark.sql.pandas.types import to_arrow_type
    return to_arrow_type(kind)


def _hits(h: np.ndarray, first: np.ndarray, seeds: np.ndarray, least: int) -> Iterator[tuple[int, np.ndarray]]:
    """(text, places of its seeds that the benchmark has) where there are any."""
    keys = shingle_hashes(h, least)
    if not len(keys) or not len(seeds):
        return
    at = np.minimum(np.searchsorted(seeds, keys), len(seeds) - 1)
    hit = np.flatnonzero(seeds[at] == keys)
    doc = np.searchsorted(first, hit, "right") - 1
    inside = hit + least <= first[doc + 1]
    hit, doc = hit[inside], doc[inside]
    each, begin = np.unique(doc, return_index=True)
    for d, x, y in zip(each.tolist(), begin.tolist(), [*begin[1:].tolist(), len(doc)]):
        yield d, hit[x:y] - first[d]


def _by_join(docs: DataFrame, rows: DataFrame, items: DataFrame, kind: str, least: int, coverage: float) -> DataFrame:
    """The same for a benchmark of any size: documents and items meet in a join
    of their seeds, and each pair is tiled where it meets."""
    rows = materialize(rows.withColumn("_rid", F.monotonically_increasing_id()), "rows")
    items = items.withColumn("_item", F.monotonically_increasing_id())
    items = materialize(items, "items")

    def item_seeds(batches):
        for batch in batches:
            for item, words in zip(batch.column("_item").to_pylist(), batch.column("words").to_pylist()):
                h = np.frombuffer(words, np.uint64)
                size = min(least, len(h))
                keys = np.unique(shingle_hashes(h, size))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(keys), item)), pa.array(np.full(len(keys), size)), pa.array(keys.view(np.int64))],
                    ["_item", "size", "seed"])

    seeds_of_items = materialize(items.select("_item", "words")
                                 .mapInArrow(item_seeds, "_item long, size long, seed long"), "seeds")
    sizes = [r["size"] for r in seeds_of_items.select("size").distinct().collect()]  # 1 to ``least``
    word = F.shiftrightunsigned("seed", 64 - FILTER_BITS)
    bits = np.zeros(1 << FILTER_BITS - 6, np.int64)  # 2**FILTER_BITS bits, whatever the benchmark's size
    for r in seeds_of_items.groupBy(F.shiftright(word, 6).alias("at")) \
            .agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(seed, {64 - FILTER_BITS}) & 63 as int))"))
                 .alias("bits")).toLocalIterator():
        bits[r["at"]] = r["bits"]
    known = docs.sparkSession.sparkContext.broadcast(bits)

    def doc_seeds(batches):
        for batch in batches:
            for part in slices(batch, "_text"):
                h, first = word_hashes(part.column("_text"))
                for size in sizes:
                    keys = shingle_hashes(h, size)
                    top = (keys >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
                    at = np.flatnonzero(known.value[top >> 6] >> (top & 63) & 1)
                    doc = np.searchsorted(first, at, "right") - 1
                    ok = at + size <= first[doc + 1]
                    row = part.column("_rid").to_numpy()[doc[ok]]
                    one = np.unique(np.stack([row, keys[at[ok]].view(np.int64)]), axis=1)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(one[0]), pa.array(np.full(one.shape[1], size)), pa.array(one[1])], ["_rid", "size", "seed"])

    pairs = rows.select("_rid", "_text").mapInArrow(doc_seeds, "_rid long, size long, seed long") \
        .join(seeds_of_items, ["size", "seed"]).select("_rid", "_item").distinct()
    met = pairs.join(rows.select("_rid", "_text"), "_rid").join(items, "_item")

    def compare(batches):
        for batch in batches:
            out, rid = [], []
            texts, words = batch.column("_text"), batch.column("words").to_pylist()
            for k, (r, item) in enumerate(zip(batch.column("_rid").to_pylist(), batch.column("item").to_pylist())):
                h, first = word_hashes(texts.slice(k, 1))
                bench = Items([item], [np.frombuffer(words[k], np.uint64)], least)
                for some in bench.all_leaks(h, first, coverage):
                    out += some
                    rid += [r] * len(some)
            yield pa.RecordBatch.from_arrays([pa.array(rid, pa.int64()), pa.array(out, leak_type)], ["_rid", "leak"])

    schema = rows.select("_rid", F.array().cast(kind).alias("leaks")).schema
    leak_type = _arrow(schema["leaks"].dataType.elementType)
    found = met.mapInArrow(compare, f"_rid long, leak {schema['leaks'].dataType.elementType.simpleString()}") \
        .groupBy("_rid").agg(F.sort_array(F.collect_list("leak")).alias("leaks"))
    return rows.join(found, "_rid", "left").select(
        *[F.col("_row").getField(c).alias(c) for c in docs.columns],
        F.coalesce("leaks", F.array().cast(kind)).alias("leaks"))


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    """One row per benchmark item that leaks into a document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return find_leaks(docs, benchmark).where(F.size("leaks") > 0) \
        .select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")
