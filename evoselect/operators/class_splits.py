"""Split sums and leaf majorities of many classes, without a table of their cells (ML1a-c).

A histogram by (node, feature, bin, class) has nearly as many cells as rows when
classes are small: each row is then moved once per node and feature.  But a split
needs only sums over classes, and a leaf only its top class.  So the rows are
partitioned and sorted by class, a task counts some whole classes at a time in an
array (class, feature, bin), and what leaves it has no class axis:

* per (node, f, b): training and test rows, and what moving bin ``b`` to the left
  adds to the sums of squares (``splits.bin_sums`` has the same columns);
* per (node, f, side): the top class of either side of a threshold, one row for
  each range of thresholds over which class and counts stay the same.

Both add up over tasks because no class is in two of them.  That holds for classes
of some size only; larger ones go through the histogram, whose cells are few then
(``tree_fitness.prepare`` tells them apart).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, IntegerType, LongType, StructField, StructType

from .histogram import Block, bins_matrix

#: values (rows x features) that a task gathers before it counts whole classes
GATHER = 2_000_000
#: values that a task has, nearly; at least ``PER_CELL`` for each cell of its sums
TASK_VALUES, PER_CELL = 2_000_000, 10
#: cells (class, feature, bin) that are counted at once (few: the arrays stay in the cache)
COUNT_CELLS = 100_000


class _Node:
    """Sums of one node over the classes met so far, by (feature, bin)."""

    def __init__(self, width: int, n_bins: int):
        self.train, self.test, self.left2, self.right2 = np.zeros((4, width, n_bins), np.int64)
        self.total2 = np.zeros(width, np.int64)
        # per side: training rows of the top class (-1: no class there), its test rows, its label
        self.top = [(np.full((width, n_bins), -1, np.int64), np.zeros((width, n_bins), np.int64),
                     np.empty((width, n_bins), object)) for _ in (0, 1)]

    def add(self, train: np.ndarray, test: np.ndarray, labels: np.ndarray) -> None:
        """Counts (class, feature, bin) of further classes, larger than those before."""
        self.train += train.sum(0)
        self.test += test.sum(0)
        left, left_test = train.cumsum(2), test.cumsum(2)
        right, right_test = left[:, :, -1:] - left, left_test[:, :, -1:] - left_test
        self.left2 += np.einsum("cfb,cfb->fb", left, left)
        self.right2 += np.einsum("cfb,cfb->fb", right, right)
        self.total2 += np.einsum("cf,cf->f", left[:, :, -1], left[:, :, -1])
        for (n, t, y), rows, rows_test in zip(self.top, (left, right), (left_test, right_test)):
            # a class without training rows may still lead where no class has any
            best = np.where(rows + rows_test > 0, rows, -1).argmax(0)[None]
            best_n, best_t = (np.take_along_axis(a, best, 0)[0] for a in (rows, rows_test))
            best_n = np.where(best_n + best_t > 0, best_n, -1)
            more = best_n > n                    # equal counts: the lower label, met before
            n[more], t[more], y[more] = best_n[more], best_t[more], labels[best[0][more]]

    def rows(self, node: int, first: int) -> Iterator[list]:
        """Columns of the output, see ``SCHEMA``."""
        f, b = np.nonzero(self.train + self.test)
        if not len(f):
            return
        gain = [np.diff(a, axis=1, prepend=p)[f, b] for a, p in ((self.left2, 0), (self.right2, self.total2[:, None]))]
        once = np.where(b == (self.train > 0).argmax(1)[f], self.total2[f], 0)      # a bin with training rows carries it
        yield [node, f + first, b, b, -1, np.full(len(f), None, object), self.train[f, b], self.test[f, b], *gain, once]
        for side, (n, t, y) in enumerate(self.top):
            new = np.ones(n.shape, bool)
            new[:, 1:] = (n[:, 1:] != n[:, :-1]) | (t[:, 1:] != t[:, :-1]) | (y[:, 1:] != y[:, :-1])
            f, b = np.nonzero(new)
            last = np.append(np.where(f[1:] == f[:-1], b[1:] - 1, n.shape[1] - 1), n.shape[1] - 1)
            some = n[f, b] >= 0
            f, b, last = f[some], b[some], last[some]
            none = np.zeros(len(f), np.int64)
            yield [node, f + first, b, last, side, y[f, b], n[f, b], t[f, b], none, none, none]


def _count(nodes: dict, blocks: list[Block], n_bins: int, x: np.ndarray, test: np.ndarray,
           number: np.ndarray, labels: np.ndarray) -> None:
    """Adds whole classes: ``number`` (ascending) is a row's place in ``labels``."""
    edges = np.searchsorted(number, np.arange(len(labels) + 1))
    for block in blocks:
        width = len(range(*slice(block.first, block.stop).indices(x.shape[1])))
        step = max(1, COUNT_CELLS // max(1, width * n_bins))
        for lo in range(0, len(labels), step):
            hi = min(lo + step, len(labels))
            rows = slice(edges[lo], edges[hi])
            part = x[rows, block.first:block.stop]
            code = ((number[rows, None] - lo) * width + np.arange(width)) * n_bins + part
            code[part < 0] = -1
            shape, of = (hi - lo, width, n_bins), test[rows].astype(bool)

            def counts(mine, shape=shape, code=code):
                found = code[mine].ravel()
                return np.bincount(found[found >= 0], minlength=shape[0] * shape[1] * shape[2]).reshape(shape)
            whole = counts(~of), counts(of)
            for r, limit in zip(block.roots, block.limits):
                if r < 0:
                    sides = [(-1, whole)]
                else:
                    took = x[rows, r] <= limit
                    left = counts(took & ~of), counts(took & of)
                    sides = [(2 * r, left), (2 * r + 1, (whole[0] - left[0], whole[1] - left[1]))]
                for node, (train, tests) in sides:
                    key = (node, block.first)
                    if key not in nodes:
                        nodes[key] = _Node(width, n_bins)
                    nodes[key].add(train, tests, labels[lo:hi])


def class_sums(rows: DataFrame, blocks: list[Block], n_bins: int, n_features: int, n_rows: int) -> DataFrame:
    """(node, f, b, upto, side, y, n_train, n_test, d_left, d_right, sq_total) from rows
    (y, is_test, bins); side -1: sums of bin ``b``; 0 or 1: top class ``y`` left or
    right of each threshold from ``b`` to ``upto``.  One row per task that has some.
    ``n_rows`` (nearly) sets the number of tasks."""
    kind = rows.schema["y"].dataType
    # -0.0 and 0.0 are one class
    label = F.col("y") + F.lit(0).cast(kind) if isinstance(kind, (DoubleType, FloatType)) else F.col("y")
    cells = sum(2 * len(b.roots) * len(range(n_features)[b.first:b.stop]) * n_bins for b in blocks)
    tasks = 1 + n_rows * n_features // max(TASK_VALUES, PER_CELL * cells)
    rows = rows.select(label.alias("y"), "is_test", "bins").repartition(tasks, "y").sortWithinPartitions("y")
    schema = StructType([*[StructField(c, IntegerType()) for c in ("node", "f", "b", "upto", "side")], StructField("y", kind),
                         *[StructField(c, LongType()) for c in ("n_train", "n_test", "d_left", "d_right", "sq_total")]])
    gather = max(1, GATHER // max(1, n_features))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes: dict = {}
        held: list[tuple] = []                 # (labels, bins, is_test), not counted yet
        n_held, y_type = 0, None

        def count(last: bool) -> int:
            """Counts the classes that are whole; the last one may go on."""
            y = pa.chunked_array([h[0] for h in held]).combine_chunks().dictionary_encode()
            x, test = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
            code = y.indices.fill_null(-1).to_numpy()
            starts = np.flatnonzero(np.diff(code, prepend=-2))
            end = len(code) if last else starts[-1]
            if end:
                starts = starts[starts < end]
                number = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, end)))
                labels = np.empty(len(starts), object)
                labels[:] = y.take(pa.array(starts)).to_pylist()
                _count(nodes, blocks, n_bins, x[:end], test[:end], number, labels)
            held[:] = [(y.dictionary_decode().slice(end), x[end:], test[end:])] if end < len(code) else []
            return len(code) - end
        limit = gather
        for batch in batches:
            if not batch.num_rows:
                continue
            found = bins_matrix(batch.column("bins"))[:, :n_features]
            x = np.full((len(found), n_features), -1, np.int32)
            x[:, :found.shape[1]] = found
            held.append((batch.column("y"), x, batch.column("is_test").to_numpy(zero_copy_only=False)))
            n_held, y_type = n_held + len(x), batch.column("y").type
            if n_held >= limit:
                n_held = count(False)
                limit = n_held + gather
        if held:
            count(True)
        for (node, first), sums in sorted(nodes.items()):
            for c in sums.rows(node, first):
                size = len(c[1])
                yield pa.RecordBatch.from_arrays([
                    pa.array(v, y_type) if s.name == "y" else
                    pa.array(np.broadcast_to(v, size).astype(np.int64 if isinstance(s.dataType, LongType) else np.int32))
                    for v, s in zip(c, schema)], schema.names)
    return rows.mapInArrow(run, schema)
