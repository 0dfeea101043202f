"""Quality classifier: a factorisation machine (operator 7).

    y(x) = w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)

The features are the hashed distinct words of a document (each ``1 / sqrt(n)``
for n of them), structure statistics of its text, and its metadata column
``n_chars`` (a null counts as the text's length).  The pairwise term is scored
in time linear in the features, by the sum-of-squares identity above.

The fit, in numpy on the driver, uses at most ``MOST_ROWS`` labelled documents,
chosen by a hash of their id from the training folds.  Every document is
scored on its whole text, in the task that reads it.

Null and empty texts have no words and zero statistics, and get a score.
Labels that repeat or contradict count by their smallest value; null labels
count for nothing.  Without both classes in the training rows every score is
the share of 1s (0 without labels).  Repeated rows and null ids are scored
like others; null ids are never trained on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .features import bins, first_rows, fold, segment_sum, unpack, vocabulary
from .packing import slices
from .words import text_bytes

MOST_ROWS = 8_000
BITS = 16
RANK = 8
THRESHOLD = 0.3
STATS = ("words", "word_bytes", "repeated", "same_neighbour", "upper", "digit", "mark", "pipe", "dot", "line",
         "space", "wide", "n_chars")


@dataclass
class Model:
    w0: float
    w: np.ndarray
    v: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    bits: int


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256, np.float64)
    out[np.frombuffer(chars.encode(), np.uint8)] = 1
    return out


_BYTES = np.stack([
    _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class("0123456789"), _class("!#$%&*+<=>?@[]^_{}~\\/"), _class("|"),
    _class(".,;:"), _class("\n"), _class(" \t"), (np.arange(256) >= 0x80).astype(float)], 1)


def document_features(column, n_chars: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashed word, where each text's words begin, statistics by text)."""
    v = vocabulary(column)
    w = v.words
    doc, word = v.per_doc()
    first = np.searchsorted(doc, np.arange(len(w.first)))
    n = w.counts.astype(float)
    raw, offsets = text_bytes(column)
    size = np.diff(offsets).astype(float)
    shares = np.stack([segment_sum(_BYTES[raw, k], offsets) for k in range(_BYTES.shape[1])], 1) \
        / np.maximum(size, 1)[:, None]
    same = np.zeros(len(v.which))
    same[1:] = v.which[1:] == v.which[:-1]
    same[w.first[:-1][w.counts > 0]] = 0
    chars = np.where(np.isnan(n_chars), size, n_chars)
    stats = np.column_stack([
        np.log1p(n), segment_sum((w.ends - w.starts).astype(float), w.first) / np.maximum(n, 1),
        np.where(n > 0, 1 - np.diff(first) / np.maximum(n, 1), 0), segment_sum(same, w.first) / np.maximum(n, 1),
        shares, np.log1p(np.maximum(chars, 0))])
    return bins(v.keys, bits)[word], first, stats



def _rows(flat: np.ndarray, first: np.ndarray, stats: np.ndarray, m: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, value, where each row begins) with the statistics at the end
    of the feature space."""
    n = np.diff(first)
    s = stats.shape[1]
    begin = first + s * np.arange(len(first))
    feature, value = np.empty(int(begin[-1]), np.int64), np.empty(int(begin[-1]))
    at = np.arange(len(flat)) + s * np.repeat(np.arange(len(n)), n)
    feature[at] = flat
    value[at] = np.repeat(1 / np.sqrt(np.maximum(n, 1)), n)
    at = (begin[1:] - s)[:, None] + np.arange(s)
    feature[at] = (1 << m.bits) + np.arange(s)
    value[at] = np.clip((stats - m.mean) / m.scale, -4, 4)
    return feature, value, begin


def _score(m: Model, feature: np.ndarray, value: np.ndarray, begin: np.ndarray):
    vx = m.v[feature] * value[:, None]
    total = segment_sum(vx, begin)
    squares = segment_sum((vx * vx).sum(1), begin)
    return m.w0 + segment_sum(m.w[feature] * value, begin) + 0.5 * ((total * total).sum(1) - squares), vx, total


def fit(flat: np.ndarray, first: np.ndarray, stats: np.ndarray, y: np.ndarray, bits: int = BITS, rank: int = RANK,
        epochs: int = 12, batch: int = 256, rate: float = 0.02, decay: float = 1e-4, seed: int = 11) -> Model:
    """Adam on the logistic loss."""
    rng = np.random.default_rng(seed)
    size = (1 << bits) + stats.shape[1]
    share = y.mean()
    m = Model(float(np.log(share / (1 - share))), np.zeros(size), rng.normal(0, 0.02, (size, rank)),
              stats.mean(0), stats.std(0) + 1e-6, bits)
    p = np.concatenate([m.w[:, None], m.v], 1)
    one, two, t = np.zeros_like(p), np.zeros_like(p), 0
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(len(y)), max(1, len(y) // batch)):
            count = first[rows + 1] - first[rows]
            begin = np.concatenate([[0], np.cumsum(count)])
            pick = flat[np.arange(int(begin[-1])) - np.repeat(begin[:-1] - first[rows], count)]
            feature, value, begin = _rows(pick, begin, stats[rows], m)
            z, vx, total = _score(m, feature, value, begin)
            error = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y[rows]) / len(rows)
            row = np.repeat(np.arange(len(rows)), np.diff(begin))
            pull = error[row] * value
            used, where = np.unique(feature, return_inverse=True)
            g = np.empty((len(used), rank + 1))
            g[:, 0] = np.bincount(where, pull, len(used))
            for k in range(rank):
                g[:, k + 1] = np.bincount(where, pull * (total[row, k] - vx[:, k]), len(used))
            g += decay * p[used]
            t += 1
            one[used] += 0.1 * (g - one[used])
            two[used] += 0.01 * (g * g - two[used])
            p[used] -= rate * (one[used] / (1 - 0.9 ** t)) / (np.sqrt(two[used] / (1 - 0.99 ** t)) + 1e-8)
            m.w0 -= rate * error.sum()
            m.w, m.v = p[:, 0], p[:, 1:]
    m.w, m.v = p[:, 0].copy(), p[:, 1:].copy()
    return m


def _texts(docs: DataFrame, text_col: str, chars_col: str | None):
    chars = F.col(f"`{chars_col}`").cast("double") if chars_col else F.lit(None).cast("double")
    return F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"), chars.alias("_chars")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", chars_col: str | None = "n_chars", held_out: tuple[int, int] | None = (5, 0),
          most_rows: int = MOST_ROWS, bits: int = BITS, seed: int = 11) -> Model | float:
    """A model, or the share of 1s if one class is missing."""
    ident = F.col(f"`{id_col}`")
    rows = labels.where(ident.isNotNull())
    if held_out is not None:
        rows = rows.where(fold(ident, held_out[0]) != held_out[1])
    known = rows.groupBy(ident.alias("id")).agg(F.min(label_col).alias("y")).where("y IS NOT NULL")
    some = first_rows(known, "id", most_rows, seed)
    text, chars = _texts(docs, text_col, chars_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                flat, first, stats = document_features(
                    part.column("_text"), part.column("_chars").to_numpy(zero_copy_only=False), bits)
                flat = flat.astype(np.uint32)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("y"),
                     pa.array([flat[a:b].tobytes() for a, b in zip(first, first[1:])], pa.binary()),
                     pa.array([x.tobytes() for x in stats], pa.binary())], ["id", "y", "f", "stats"])

    # at most most_rows ids
    got = docs.select(ident.alias("id"), text, chars).join(F.broadcast(some), "id").select("id", "y", "_text", "_chars") \
        .mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, "
                         f"y {labels.schema[label_col].dataType.simpleString()}, f binary, stats binary")
    data = sorted((str(r["id"]), bytes(r["f"]), bytes(r["stats"]), r["y"]) for r in got.toLocalIterator())
    y = np.array([x[3] for x in data], float)
    if not len(y) or y.min() == y.max():
        return float(y.mean()) if len(y) else 0.0
    flat, first = unpack([x[1] for x in data], np.uint32)
    stats = np.frombuffer(b"".join(x[2] for x in data)).reshape(len(y), -1)
    return fit(flat, first, stats, (y >= 0.5).astype(float), bits, seed=seed)


def score_quality(docs: DataFrame, model: Model | float, text_col: str = "text", chars_col: str | None = "n_chars",
                  score_col: str = "score") -> DataFrame:
    """``docs`` with ``score_col``, the probability of label 1.  A column of
    that name is replaced."""
    docs = docs.drop(score_col)
    if not isinstance(model, Model):
        return docs.withColumn(score_col, F.lit(float(model)))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**bits * (rank + 1) numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in slices(batch, "_text"):
                flat, first, stats = document_features(
                    part.column("_text"), part.column("_chars").to_numpy(zero_copy_only=False), m.bits)
                z = _score(m, *_rows(flat, first, stats, m))[0]
                yield pa.RecordBatch.from_arrays(
                    [part.column("_row"), pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], ["_row", "_score"])

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
                       *_texts(docs, text_col, chars_col))
    return rows.mapInArrow(run, rows.select("_row").schema.add("_score", "double")) \
        .select(*[F.col("_row").getField(c).alias(c) for c in docs.columns], F.col("_score").alias(score_col))


def op7_quality(spark, sf_dir: str) -> DataFrame:
    """One row per document: its fold, score and prediction."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "n_chars")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model = train(docs, labels)
    keep = docs.withColumn("held_out", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)))
    return score_quality(keep, model).select(
        "doc_id", "held_out", "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
