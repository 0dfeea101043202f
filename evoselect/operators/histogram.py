"""Feature x bin x class histograms (ML1a), the only full passes over data.

Node ids: ``-1`` is the root; the two children of a root split on feature
``r`` are ``2*r`` (left, ``bin <= t_r``) and ``2*r + 1`` (right).  A root
split depends only on its feature (its best threshold is fixed), so child
histograms are keyed by the root feature and can be reused by every
individual -- and every generation -- that picks the same root.

A task counts in arrays: its rows come sorted by class, and the cells of one
class at a time are counted by ``bincount`` over codes (feature, bin, side of the
hold-out) of a block, once per root of that block.  Classes with few rows are
counted together by sorting their codes.  No row is exploded into cells.  What
leaves a task is one row per cell that occurs in it, at most nodes x features x
bins x classes, whatever the number of rows.

Only the left child is counted.  The right child is the parent's cell minus the
left one, and the parents (cells of the root) are already there: both are summed
by the same aggregate.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

HIST_COLS = ["node", "f", "b", "y", "n_train", "n_test"]

#: rows of one class in a batch from which it is counted in an array of its own
BIG_CLASS = 128
#: codes that a task sorts or counts at once, and cells of its array
CODES, ARRAY_CELLS = 4_000_000, 16_000_000


@dataclass(frozen=True)
class Block:
    """Roots that share a block: features ``first`` to ``stop``; a row counts
    for root ``roots[k]`` if its bin there is at most ``limits[k]``; root -1
    takes every row."""
    first: int
    stop: int | None
    roots: tuple[int, ...]
    limits: tuple[int, ...]


def bins_matrix(column: pa.Array) -> np.ndarray:
    """Bins as a matrix; shorter rows are filled with -1."""
    size = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int32)
    if not len(size) or (size == size[0]).all():
        return flat.reshape(len(size), -1)
    x = np.full((len(size), size.max()), -1, np.int32)
    x[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return x


class _Counter:
    """Cells of one task.  A code is (feature within the block, bin, is_test)."""

    def __init__(self, blocks: list[Block], n_bins: int):
        self.blocks, self.n_bins = blocks, n_bins
        self.now = None                       # class whose arrays are open
        self.arrays: list[np.ndarray] = []
        self.out: list[tuple] = []            # (roots, features, bins, class, train, test)

    def codes(self, block: Block, x: np.ndarray, test: np.ndarray) -> np.ndarray:
        part = x[:, block.first:block.stop]
        feature = np.arange(part.shape[1], dtype=np.int64)
        code = (feature * self.n_bins + part) * 2 + test[:, None]
        code[part < 0] = -1
        return code

    @staticmethod
    def left(block: Block, x: np.ndarray) -> np.ndarray:
        """(row, root) of the rows that count for a root."""
        roots = np.array(block.roots)
        return (roots < 0) | (x[:, np.maximum(roots, 0)] <= np.array(block.limits))

    def emit(self, block: Block, code: np.ndarray, count: np.ndarray, root: np.ndarray, label) -> None:
        """Cells from counted codes: the two sides of the hold-out of a cell
        are two rows here, added later."""
        cell, test = code >> 1, code & 1
        n = count.astype(np.int64)
        self.out.append((np.array(block.roots, np.int32)[root], (cell // self.n_bins + block.first).astype(np.int32),
                         (cell % self.n_bins).astype(np.int32), label, np.where(test == 0, n, 0), np.where(test == 1, n, 0)))

    def big(self, label: int, x: np.ndarray, test: np.ndarray) -> None:
        """One class with many rows: its arrays stay open while it lasts."""
        if self.now != label:
            self.close()
            self.now = label
            self.arrays = [np.zeros((len(b.roots), self.width(b, x) * self.n_bins * 2), np.int64) for b in self.blocks]
        for block, array in zip(self.blocks, self.arrays):
            step = max(1, CODES // max(1, self.width(block, x)))
            for lo in range(0, len(x), step):
                part = x[lo:lo + step]
                code = self.codes(block, part, test[lo:lo + step])
                whole = code.min(initial=0) >= 0
                took = self.left(block, part)
                for k in range(len(block.roots)):
                    mine = code[took[:, k]].ravel()
                    array[k] += np.bincount(mine if whole else mine[mine >= 0], minlength=array.shape[1])

    def small(self, labels: np.ndarray, x: np.ndarray, test: np.ndarray) -> None:
        """Rows of many classes, counted together."""
        for block in self.blocks:
            width = self.width(block, x) * self.n_bins * 2
            step = max(1, CODES // max(1, len(block.roots) * self.width(block, x)))
            for lo in range(0, len(x), step):
                part = x[lo:lo + step]
                row, root = np.nonzero(self.left(block, part))
                code = self.codes(block, part, test[lo:lo + step])[row]
                key = (labels[lo:lo + step][row] * len(block.roots) + root)[:, None] * width + code
                key, count = np.unique(key[code >= 0], return_counts=True)
                owner = key // width
                self.emit(block, key % width, count, owner % len(block.roots), owner // len(block.roots))

    @staticmethod
    def width(block: Block, x: np.ndarray) -> int:
        return x[:1, block.first:block.stop].shape[1]

    def close(self) -> None:
        for block, array in zip(self.blocks, self.arrays):
            root, code = np.nonzero(array)
            if len(root):
                self.emit(block, code, array[root, code], root, np.full(len(root), self.now))
        self.now, self.arrays = None, []

    def take(self) -> list[np.ndarray] | None:
        out = [np.concatenate(c) for c in zip(*self.out)] if self.out else None
        self.out = []
        return out


def _cells(binned: DataFrame, blocks: list[Block], n_bins: int) -> DataFrame:
    """(r, f, b, y, n_train, n_test): one row per cell and side of the hold-out
    that occurs in a task."""
    rows = binned.select("y", F.col("is_test").alias("is_test"), "bins")
    kind = rows.schema["y"]
    schema = StructType([*[StructField(c, IntegerType()) for c in ("r", "f", "b")], StructField("y", kind.dataType),
                         StructField("n_train", LongType()), StructField("n_test", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _Counter(blocks, n_bins)
        known: dict = {}                       # class -> number, for the classes still to be sent
        values: list = []

        def send(y_type):
            cells = counter.take()
            if cells is not None:
                cells[3] = pa.array(values, y_type).take(pa.array(cells[3]))
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cells],
                                                 schema.names)
        for batch in batches:
            if not batch.num_rows:
                continue
            y = batch.column("y").dictionary_encode()
            x, test = bins_matrix(batch.column("bins")), batch.column("is_test").to_numpy(zero_copy_only=False).astype(np.int64)
            if len(values) > 100_000:
                counter.close()
                yield from send(batch.column("y").type)
                known, values = {}, []
            own = y.dictionary.to_pylist() + [None]
            for v in own:
                if v not in known:
                    known[v] = len(values)
                    values.append(v)
            number = np.array([known[v] for v in own])[y.indices.fill_null(len(own) - 1).to_numpy()]
            order = np.argsort(number, kind="stable")
            x, test, number = x[order], test[order], number[order]
            edges = np.concatenate([[0], np.flatnonzero(np.diff(number)) + 1, [len(number)]])
            many = np.diff(edges) >= BIG_CLASS
            if (rest := ~np.repeat(many, np.diff(edges))).any():
                counter.small(number[rest], x[rest], test[rest])
            for a, b in zip(edges[:-1][many], edges[1:][many]):
                counter.big(number[a], x[a:b], test[a:b])
            yield from send(batch.column("y").type)
        counter.close()
        if values:
            yield from send(y_type=batch.column("y").type)
    return rows.mapInArrow(run, schema)


def _max_bin(binned: DataFrame) -> int:
    return (binned.agg(F.max(F.array_max("bins"))).first()[0] or 0) + 1


def root_histogram(binned: DataFrame, n_bins: int | None = None) -> DataFrame:
    """Counts of (feature, bin, class) over all rows, node = -1.  ``n_bins``:
    numbers that bins can have (default: looked up)."""
    cells = _cells(binned, [Block(0, None, (-1,), (0,))], n_bins or _max_bin(binned))
    return cells.groupBy("f", "b", "y").agg(F.sum("n_train").alias("n_train"), F.sum("n_test").alias("n_test")) \
        .select(F.lit(-1).alias("node"), "f", "b", "y", "n_train", "n_test")


def root_passes(roots: DataFrame, block_size: int, n_features: int, n_bins: int, array_cells: int) -> list[list[Block]]:
    """The blocks and their roots, by passes whose arrays have at most ``array_cells``
    cells (one root at least)."""
    passes: list[list[Block]] = [[]]
    room = array_cells
    by_block: dict[int, list[tuple[int, int]]] = {}
    for r in roots.select("block", "r", "t_r").collect():          # at most one row per feature
        by_block.setdefault(r["block"], []).append((r["r"], r["t_r"]))
    for block, found in sorted(by_block.items()):
        first, stop = block * block_size, min((block + 1) * block_size, n_features)
        cells = (stop - first) * n_bins * 2
        found.sort()
        while found:
            fit = max(1, room // cells) if room >= cells or not passes[-1] else 0
            if not fit:
                passes.append([])
                room = array_cells
                continue
            some, found = found[:fit], found[fit:]
            passes[-1].append(Block(first, stop, tuple(r for r, _ in some), tuple(t for _, t in some)))
            room -= len(some) * cells
    return passes


def child_histogram(binned: DataFrame, roots: DataFrame, block_size: int, n_features: int,
                    root_hist: DataFrame, n_bins: int | None = None) -> DataFrame:
    """Counts of (child node, feature, bin, class) for the given root splits.

    ``roots`` has columns (r, t_r, block): root feature, its threshold and its
    block.  It holds at most one row per feature (a root is a feature), and so
    goes to the tasks as a list.  Roots whose arrays would not fit into a task
    together are counted in further passes.
    """
    n_bins = n_bins or _max_bin(binned)
    passes = root_passes(roots, block_size, n_features, n_bins, ARRAY_CELLS)
    zero = F.lit(0).cast("bigint")
    parents = root_hist.withColumn("block", F.floor(F.col("f") / block_size).cast("int")) \
        .join(roots.select("r", "block"), "block") \
        .select("r", "f", "b", "y", zero.alias("n_train"), zero.alias("n_test"),
                F.col("n_train").alias("p_train"), F.col("n_test").alias("p_test"))
    both = parents
    for blocks in passes:
        if blocks:
            both = both.unionByName(_cells(binned, blocks, n_bins).withColumns({"p_train": zero, "p_test": zero}))
    sums = both.groupBy("r", "f", "b", "y").agg(*[F.sum(c).alias(c) for c in ("n_train", "n_test", "p_train", "p_test")])
    left = F.struct((F.col("r") * 2).alias("node"), "n_train", "n_test")
    right = F.struct((F.col("r") * 2 + 1).alias("node"), (F.col("p_train") - F.col("n_train")).alias("n_train"),
                     (F.col("p_test") - F.col("n_test")).alias("n_test"))
    return sums.select("f", "b", "y", F.explode(F.array(left, right)).alias("n")) \
        .select("n.node", "f", "b", "y", "n.n_train", "n.n_test").where("n_train + n_test > 0").select(*HIST_COLS)
