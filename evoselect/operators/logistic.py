"""Batched multinomial logistic regression: all models of a population at once
(ML2, ML3, ML4, P3, P12-P14).

The reference fits one model per (individual, block).  Here every distinct model
(a block with the features selected in it) is a row of one optimiser state, and
**one pass over the training rows is one step of all of them**:

* a task multiplies its rows, block by block, with the coefficients of all
  models of that block, and adds up loss and gradient of each model;
* the tasks' partial sums are added in a tree (``FAN_IN`` at a time) and the
  driver receives one gradient per model;
* L-BFGS (two-loop recursion over ``MEMORY`` pairs, Armijo backtracking) moves
  each model on its own: a model may accept its step while another halves its
  own, and models that have converged leave the pass.

So the number of data passes is that of the slowest model, not population x
blocks x iterations.  Models are fitted in waves whose state stays within
``STATE_BYTES``, whatever the population and the number of classes.

The objective is that of ``pyspark.ml`` with ``family="multinomial"``, no
intercept and no penalty: features are divided by their standard deviation
while fitting (constant ones get coefficient 0), and the coefficients of a
feature add up to 0 over the classes.  A model has converged when no component
of the gradient of the mean loss exceeds ``TOL``; separable classes, whose
optimum lies at infinity, end there too, or after ``MAX_PASSES``.

NULL, NaN and infinite values count as 0.  Rows without a label take no part;
a class that only test rows have is never predicted.  Equal scores go to the
lower class.  No training rows or no test rows: fitness NULL.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from ..sources.datasets import LabeledTable

TOL = 1e-8
MAX_PASSES = 400
#: correction pairs of a model
MEMORY = 8
#: bytes of optimiser state on the driver, and of partial sums sent to it at once
STATE_BYTES, PARTIAL_BYTES = 256 << 20, 64 << 20
#: partial sums that one task of the tree adds, and bytes of one piece of them
FAN_IN, PIECE_BYTES = 32, 1 << 20
#: numbers that a task holds at once for (rows x models x classes)
CELLS = 2_000_000


@dataclass
class LogisticData:
    train: DataFrame            # y int, x array<double> (scaled)
    test: DataFrame             # row_key, y int, x
    classes: list
    scale: np.ndarray           # 0 for constant features
    n_features: int
    block_size: int
    n_train: int
    n_test: int
    tasks: int
    label_type: str

    @property
    def n_blocks(self) -> int:
        return -(-self.n_features // self.block_size)


def prepare_logistic(table: LabeledTable, block_size: int) -> LogisticData:
    """Scale the features and number the classes, once per run."""
    spark = table.df.sparkSession
    rows = table.df.where(F.col("label").isNotNull()).select(
        "row_key", "label", "is_test",
        F.transform("features", lambda v: F.when(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")), v)
                    .otherwise(0.0)).alias("x"))
    train = rows.where(~F.col("is_test"))
    # one number per feature; one value per class
    spread = {r["f"]: r["s"] for r in train.select(F.posexplode("x").alias("f", "v")).groupBy("f")
              .agg(F.stddev_samp("v").alias("s")).collect()}
    std = np.array([spread.get(f) or 0.0 for f in range(table.n_features)])
    scale = np.divide(1.0, std, out=np.zeros_like(std), where=std > 0)
    classes = [r["label"] for r in train.select("label").distinct().orderBy("label").collect()]
    numbers = spark.createDataFrame(list(enumerate(classes)), rows.select(F.lit(0).alias("y"), "label").schema)
    by = F.lit(scale.tolist())
    coded = rows.join(numbers, "label", "left").select(
        "row_key", "is_test", F.coalesce("y", F.lit(-1)).alias("y"),
        F.transform("x", lambda v, f: v * F.element_at(by, f + 1)).alias("x"))
    coded = materialize(coded, "logistic_data")
    count = coded.groupBy("is_test").count().collect()
    n = {r["is_test"]: r["count"] for r in count}
    train = coded.where(~F.col("is_test")).select("y", "x")
    return LogisticData(train, coded.where("is_test").select("row_key", "y", "x"), classes, scale,
                        table.n_features, block_size, n.get(False, 0), n.get(True, 0), train.rdd.getNumPartitions(),
                        numbers.schema["label"].dataType.simpleString())


# ------------------------------------------------------------------- models
@dataclass(frozen=True)
class Model:
    """A block and the features selected in it (numbers within the block)."""
    block: int
    chosen: tuple[int, ...]


def distinct_models(genomes: dict[int, list[int]], data: LogisticData) -> dict[int, list[Model]]:
    """Each individual's models; equal ones of several individuals are equal."""
    size = data.block_size
    return {ind: [Model(b, tuple(f for f, bit in enumerate(g[b * size:(b + 1) * size]) if bit))
                  for b in range(data.n_blocks)] for ind, g in genomes.items()}


def waves(models: list[Model], data: LogisticData) -> Iterator[list[Model]]:
    """The models in groups whose optimiser state fits into ``STATE_BYTES``."""
    one = data.block_size * max(1, len(data.classes)) * 8 * (2 * MEMORY + 6)
    step = max(1, STATE_BYTES // one)
    models = sorted(models, key=lambda m: (m.block, m.chosen))
    for k in range(0, len(models), step):
        yield models[k:k + step]


def _by_block(models: list[Model], active: np.ndarray) -> dict[int, np.ndarray]:
    blocks = np.array([m.block for m in models])
    return {int(b): np.flatnonzero((blocks == b) & active) for b in np.unique(blocks[active])}


def _scores(x: np.ndarray, w: np.ndarray, block: int, size: int) -> np.ndarray:
    """(rows, models, classes) of one block; ``w`` is (models, size, classes)."""
    xb = x[:, block * size:(block + 1) * size]
    m, _, k = w.shape
    return (xb @ w[:, :xb.shape[1]].transpose(1, 0, 2).reshape(xb.shape[1], m * k)).reshape(len(x), m, k)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def evaluate(data: LogisticData, models: list[Model], w: np.ndarray, active: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mean loss, its gradient) of the active models: one pass over the rows."""
    size, width, groups = data.block_size, data.n_features, _by_block(models, active)
    coefficients = {b: w[at] for b, at in groups.items()}
    k = w.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss = {b: np.zeros(len(c)) for b, c in coefficients.items()}
        grad = {b: np.zeros(c.shape) for b, c in coefficients.items()}
        for batch in batches:
            x, y = _matrix(batch.column("x"), width), batch.column("y").to_numpy()
            for b, c in coefficients.items():
                step = max(1, CELLS // (len(c) * k))
                for lo in range(0, len(x), step):
                    part, own = x[lo:lo + step], y[lo:lo + step]
                    z = _scores(part, c, b, size)
                    top = z.max(2, keepdims=True)
                    right = z[np.arange(len(own)), :, own]
                    np.exp(z - top, out=z)
                    total = z.sum(2, keepdims=True)
                    loss[b] += (np.log(total) + top)[:, :, 0].sum(0) - right.sum(0)
                    z /= total
                    z[np.arange(len(own)), :, own] -= 1
                    xb = part[:, b * size:(b + 1) * size]
                    g = (xb.T @ z.reshape(len(part), -1)).reshape(xb.shape[1], len(c), k)
                    grad[b][:, :xb.shape[1]] += g.transpose(1, 0, 2)
        flat = np.concatenate([np.concatenate([loss[b], grad[b].ravel()]) for b in sorted(coefficients)])
        step = PIECE_BYTES // 8
        pieces = [flat[p:p + step].tobytes() for p in range(0, len(flat), step)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(pieces)), pa.int32()), pa.array(pieces, pa.binary())],
                                         ["piece", "sums"])

    total = _tree_sum(data.train.mapInArrow(run, "piece int, sums binary"), data.tasks,
                      int(active.sum()) * w[0].size * 8)
    loss, grad, at = np.zeros(len(models)), np.zeros_like(w), 0
    for b in sorted(groups):
        m = len(groups[b])
        loss[groups[b]] = total[at:at + m]
        grad[groups[b]] = total[at + m:at + m + m * w[0].size].reshape(m, *w.shape[1:])
        at += m + m * w[0].size
    return loss / data.n_train, grad / data.n_train


def _add(blobs: list[bytes]) -> np.ndarray:
    return np.sum([np.frombuffer(b, np.float64) for b in blobs], axis=0)


def _tree_sum(partial: DataFrame, tasks: int, size: int) -> np.ndarray:
    """Sum of one vector per task; the driver adds the last few of them."""
    schema = "piece int, sums binary, task int"
    partial = partial.withColumn("task", F.spark_partition_id())

    def add(table: pa.Table) -> pa.Table:
        return pa.table({"piece": table["piece"].slice(0, 1),
                         "sums": pa.array([_add(table["sums"].to_pylist()).tobytes()], pa.binary()),
                         "task": table["task"].slice(0, 1)}).cast(arrow)
    arrow = pa.schema([("piece", pa.int32()), ("sums", pa.binary()), ("task", pa.int32())])
    while tasks > 1 and tasks * size > PARTIAL_BYTES:
        partial = partial.withColumn("task", F.floor(F.col("task") / FAN_IN).cast("int")) \
            .groupBy("piece", "task").applyInArrow(add, schema)
        tasks = -(-tasks // FAN_IN)
    pieces: dict[int, list[bytes]] = {}
    for r in partial.orderBy("piece", "task").collect() if tasks > 1 else partial.collect():
        pieces.setdefault(r["piece"], []).append(bytes(r["sums"]))
    return np.concatenate([_add(pieces[p]) for p in sorted(pieces)])


# ---------------------------------------------------------------- optimiser
def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.einsum("md,md->m", a, b)


@dataclass
class _Pairs:
    """The last steps and gradient changes of every model, newest last."""
    s: np.ndarray
    y: np.ndarray
    rho: np.ndarray             # 0: no pair

    @classmethod
    def none(cls, models: int, width: int) -> _Pairs:
        return cls(np.zeros((MEMORY, models, width)), np.zeros((MEMORY, models, width)), np.zeros((MEMORY, models)))

    def push(self, at: np.ndarray, s: np.ndarray, y: np.ndarray) -> None:
        curve = _dot(s, y)
        good = curve > 1e-300
        at, s, y, curve = at[good], s[good], y[good], curve[good]
        for kept, new in ((self.s, s), (self.y, y), (self.rho, 1 / curve)):
            kept[:-1, at] = kept[1:, at]
            kept[-1, at] = new

    def direction(self, at: np.ndarray, g: np.ndarray) -> np.ndarray:
        """Two-loop recursion: minus the inverse Hessian times ``g``."""
        q = g.copy()
        alpha = np.zeros((MEMORY, len(at)))
        for k in range(MEMORY - 1, -1, -1):
            alpha[k] = self.rho[k, at] * _dot(self.s[k, at], q)
            q -= alpha[k][:, None] * self.y[k, at]
        yy = _dot(self.y[-1, at], self.y[-1, at])
        fresh = self.rho[-1, at] == 0
        first = 1 / np.maximum(1.0, np.sqrt(_dot(g, g)))
        with np.errstate(divide="ignore", invalid="ignore"):
            q *= np.where(fresh, first, 1 / (self.rho[-1, at] * yy))[:, None]
        for k in range(MEMORY):
            beta = self.rho[k, at] * _dot(self.y[k, at], q)
            q += (alpha[k] - beta)[:, None] * self.s[k, at]
        return -q


@dataclass
class Fit:
    """Coefficients (models, block size, classes) on scaled features."""
    models: list[Model]
    coefficients: np.ndarray
    loss: np.ndarray
    converged: np.ndarray
    passes: int


def fit(data: LogisticData, models: list[Model], tol: float = TOL, max_passes: int = MAX_PASSES) -> Fit:
    """Fit all ``models`` (one wave) side by side."""
    size, k, n = data.block_size, len(data.classes), len(models)
    mask = np.zeros((n, size, 1))
    for m, model in enumerate(models):
        for f in model.chosen:
            mask[m, f] = data.scale[model.block * size + f] > 0

    def values(w, active):
        loss, grad = evaluate(data, models, w.reshape(n, size, k), active)
        return loss, (grad * mask).reshape(n, -1)

    w = np.zeros((n, size * k))
    pairs = _Pairs.none(n, size * k)
    active = np.ones(n, bool)
    loss, grad = values(w, active)
    passes = 1
    active = abs(grad).max(1) > tol
    step = np.ones(n)
    way = np.zeros_like(w)
    way[active] = pairs.direction(np.flatnonzero(active), grad[active])
    while active.any() and passes < max_passes:
        trial = np.where(active[:, None], w + step[:, None] * way, w)
        loss2, grad2 = values(trial, active)
        passes += 1
        slope = _dot(grad, way)
        # rounding may hide the last decreases
        taken = active & (loss2 <= loss + 1e-4 * step * slope + 1e-14 * abs(loss))
        at = np.flatnonzero(taken)
        pairs.push(at, trial[at] - w[at], grad2[at] - grad[at])
        w[at], loss[at], grad[at] = trial[at], loss2[at], grad2[at]
        step = np.where(taken, 1.0, step / 2)
        stuck = active & (step < 1e-10)
        active &= ~stuck & (abs(grad).max(1) > tol)
        go = np.flatnonzero(taken & active)
        way[go] = pairs.direction(go, grad[go])
    return Fit(models, w.reshape(n, size, k), loss, abs(grad).max(1) <= tol, passes)


def _predicted(data: LogisticData, found: Fit):
    """(first model, classes (rows, models)) of a batch, block by block."""
    groups = _by_block(found.models, np.ones(len(found.models), bool))
    coefficients = {b: found.coefficients[at] for b, at in groups.items()}
    size, width = data.block_size, data.n_features

    def run(x: np.ndarray) -> Iterator[tuple[int, slice, np.ndarray]]:
        for b, c in coefficients.items():
            step = max(1, CELLS // (len(c) * c.shape[2]))
            for lo in range(0, len(x), step):
                yield b, slice(lo, lo + step), _scores(x[lo:lo + step], c, b, size).argmax(2)
    return run, groups, width


def correct_counts(data: LogisticData, found: Fit) -> np.ndarray:
    """Right test rows of each model: one pass over the test rows."""
    predict, groups, width = _predicted(data, found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        right = np.zeros(len(found.models), np.int64)
        for batch in batches:
            y = batch.column("y").to_numpy()
            for b, rows, classes in predict(_matrix(batch.column("x"), width)):
                right[groups[b]] += (classes == y[rows, None]).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(right))), pa.array(right)], ["model", "right"])

    out = np.zeros(len(found.models), np.int64)
    for r in data.test.select("y", "x").mapInArrow(run, "model long, right long").groupBy("model") \
            .agg(F.sum("right").alias("right")).collect():
        out[r["model"]] = r["right"]
    return out


def predictions(data: LogisticData, found: Fit) -> DataFrame:
    """(row_key, model, y, class): what every model says of every test row;
    ``y`` and ``class`` are numbers of ``data.classes`` (-1: none of them)."""
    predict, groups, width = _predicted(data, found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, y = batch.column("row_key"), batch.column("y")
            for b, rows, classes in predict(_matrix(batch.column("x"), width)):
                n, m = classes.shape
                row = pa.array(np.repeat(np.arange(rows.start, rows.start + n), m))
                yield pa.RecordBatch.from_arrays(
                    [keys.take(row), pa.array(np.tile(groups[b], n)), y.take(row), pa.array(classes.ravel().astype(np.int32))],
                    ["row_key", "model", "y", "class"])
    return data.test.mapInArrow(run, "row_key string, model long, y int, class int")


def individual_predictions(data: LogisticData, own: dict[int, list[Model]]) -> DataFrame:
    """(row_key, individual_id, block, label, class): the classes that the models
    of each individual give to every test row, as values of ``label``.  Waves of
    models are fitted one after another; each needs one pass to predict."""
    spark = data.test.sparkSession
    users = [(i, m) for i, models in own.items() for m in models if m.chosen]
    names = spark.createDataFrame([*enumerate(data.classes)] or [(None, None)], f"number int, label {data.label_type}")
    parts = []
    for wave in waves(list({m for _, m in users}), data):
        number = {m: k for k, m in enumerate(wave)}
        who = spark.createDataFrame([(number[m], i, m.block) for i, m in users if m in number],
                                    "model long, individual_id long, block int")
        parts.append(materialize(predictions(data, fit(data, wave)).join(who, "model"), "predictions"))
    if not parts:
        return spark.createDataFrame([], f"row_key string, individual_id long, block int, label {data.label_type}, class {data.label_type}")
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out.join(names.select(F.col("number").alias("y"), "label"), "y", "left") \
        .join(names.select(F.col("number").alias("class"), F.col("label").alias("said")), "class") \
        .select("row_key", "individual_id", "block", "label", F.col("said").alias("class"))


def coefficients(data: LogisticData, found: Fit) -> list[tuple[int, int, int, float]]:
    """(model, feature, class number, coefficient) on the features as they are."""
    size = data.block_size
    return [(m, model.block * size + f, c, float(found.coefficients[m, f, c] * data.scale[model.block * size + f]))
            for m, model in enumerate(found.models) for f in model.chosen for c in range(len(data.classes))]


def score_population_logistic(data: LogisticData, population: DataFrame) -> DataFrame:
    """(individual_id, correct, fitness, train_loss) of every individual;
    ``train_loss`` is the mean loss of its models.  Fitness is NULL when a
    block has no selected feature."""
    genomes = {r["individual_id"]: list(r["genome"])
               for r in population.select("individual_id", "genome").collect()}    # population-sized
    own = distinct_models(genomes, data)
    wanted = {m for models in own.values() for m in models if m.chosen}
    right: dict[Model, tuple[int, float]] = {}
    if data.n_train and data.n_test:
        for wave in waves(list(wanted), data):
            found = fit(data, wave)
            right.update(zip(wave, zip(correct_counts(data, found).tolist(), found.loss.tolist())))
    rows = []
    for ind, models in sorted(own.items()):
        scored = [right[m] for m in models if m in right]
        whole = len(scored) == data.n_blocks and data.n_blocks > 0
        rows.append((ind, sum(c for c, _ in scored),
                     sum(c for c, _ in scored) / (data.n_blocks * data.n_test) if whole else None,
                     sum(x for _, x in scored) / data.n_blocks if whole else None))
    return population.sparkSession.createDataFrame(
        rows, "individual_id bigint, correct bigint, fitness double, train_loss double")
