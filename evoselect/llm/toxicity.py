"""Toxicity by non-negative positive-unlabelled learning (operator 2).

Only confirmed toxic documents are labels; the other side is unlabelled text,
of which a share ``prior`` is toxic too.  A linear model on hashed words and
byte n-grams is trained in numpy with the non-negative estimator of the risk

    prior * R+(toxic) + max(0, R-(unlabelled) - prior * R-(toxic))

(R+ and R-: mean logistic loss as positive and as negative).  Where the second
term turns negative in a batch, its gradient is reversed, so the model cannot
gain by fitting the unlabelled toxic documents as negatives.

Features come in by their first gradient of that risk, and an L1 term keeps
the model sparse.  The fit uses at most ``MOST_TOXIC`` toxic and ``MOST_UNLABELLED`` unlabelled
documents, chosen by a hash of their id from the training folds; ``prior`` is
the toxic share of all labelled training rows.  Every document is scored on
its whole text, in the task that reads it.

A feature is in a document or it isn't, however often.  Null and empty texts get the score of no feature at all.  Without a toxic
training row every score is 0.  Labels that repeat or contradict count as
toxic if one says so; null labels count for nothing.  Repeated rows and null
ids are scored like others; null ids are never trained on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .features import bins, byte_ngrams, first_rows, fold, vocabulary
from .packing import slices

MOST_TOXIC = 2_000
MOST_UNLABELLED = 4_000
#: hashed features, and how many of them a model may use
BITS = 19
MOST_FEATURES = 1_500
THRESHOLD = 0.7


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    bits: int


def _word_features(v, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(feature, where each distinct word's features begin)."""
    owner, h = byte_ngrams(v, (4, 6, 8))
    owner = np.concatenate([np.arange(len(v.keys)), owner])
    f = bins(np.concatenate([v.keys, h]), bits)
    order = np.argsort(owner, kind="stable")
    return f[order], np.searchsorted(owner[order], np.arange(len(v.keys) + 1))


def document_features(column, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(feature, where each text's features begin)."""
    v = vocabulary(column)
    return _spread(v, *_word_features(v, bits))


def _spread(v, f: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of distinct words as features of texts."""
    doc, word = v.per_doc()
    size = first[word + 1] - first[word]
    begin = np.concatenate([[0], np.cumsum(size)])
    k = np.arange(int(begin[-1]))
    flat = f[k - np.repeat(begin[:-1] - first[word], size)]
    return flat, begin[np.searchsorted(doc, np.arange(len(v.words.first)))]


def select_features(toxic: np.ndarray, n_toxic: int, other: np.ndarray, n_other: int, prior: float,
                    errors: float = 2.5, least: int = 5, most: int = MOST_FEATURES) -> np.ndarray:
    """Features whose first gradient of the risk, taken where every score is
    ``prior``, lies more than ``errors`` standard errors from 0; of these the
    ``most`` that lie farthest.  ``toxic`` and ``other`` count the documents
    that have each feature."""
    p, u = toxic / n_toxic, other / n_other
    error = np.sqrt((p * (1 - p) + 1 / n_toxic) / n_toxic + (u * (1 - u) + 1 / n_other) / n_other)
    far = np.abs(u - p) / error
    far[np.maximum(toxic, other) < least] = 0
    return np.sort(np.argsort(-far, kind="stable")[:min(most, int((far > errors).sum()))])


def fit_nnpu(toxic: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 300, rate: float = 0.03,
             sparse: float = 5e-4) -> tuple[np.ndarray, float]:
    """(weights, bias) by Adam on the non-negative risk plus an L1 term.  Rows
    of the two matrices are documents."""
    w, bias = np.zeros(toxic.shape[1]), float(np.log(prior / (1 - prior)))
    m, s = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, steps + 1):
        zu = np.clip(unlabelled @ w + bias, -50, 50)
        zp = np.clip(toxic @ w + bias, -50, 50)
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        sign = 1.0 if negative >= 0 else -1.0
        gu = sign / (1 + np.exp(-zu)) / len(zu)
        rising = 1 / (1 + np.exp(-zp))
        gp = prior * ((rising - 1) * (negative >= 0) - sign * rising) / len(zp)
        g = np.append(unlabelled.T @ gu + toxic.T @ gp + sparse * np.sign(w), gu.sum() + gp.sum())
        m += 0.1 * (g - m)
        s += 0.01 * (g * g - s)
        step = rate * (m / (1 - 0.9 ** t)) / (np.sqrt(s / (1 - 0.99 ** t)) + 1e-8)
        w -= step[:-1]
        bias -= step[-1]
    return w, bias


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", held_out: tuple[int, int] | None = (3, 1), bits: int = BITS,
          most_toxic: int = MOST_TOXIC, most_unlabelled: int = MOST_UNLABELLED, seed: int = 7) -> Model | None:
    """Model, or None without a confirmed toxic document.  ``held_out``
    (folds, remainder): ids never trained on."""
    ident = F.col(f"`{id_col}`")

    def use(rows: DataFrame) -> DataFrame:
        rows = rows.where(ident.isNotNull())
        return rows if held_out is None else rows.where(fold(ident, held_out[0]) != held_out[1])

    known = use(labels).groupBy(ident.alias("id")).agg(F.max(label_col).alias("y")).where("y IS NOT NULL")
    share = known.agg(F.avg(F.col("y").cast("double")).alias("p")).first()["p"]
    if not share:
        return None
    prior = min(max(share, 0.001), 0.5)
    toxic = first_rows(known.where("y = 1").select("id"), "id", most_toxic, seed)
    text = use(docs).select(ident.alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    other = first_rows(text.select("id"), "id", most_unlabelled, seed + 1)
    ids = toxic.withColumn("side", F.lit(1)).unionByName(other.withColumn("side", F.lit(0)))
    # at most most_toxic + most_unlabelled ids; a text counts once
    sample = materialize(text.join(F.broadcast(ids), "id").select("side", "text").dropDuplicates(), "sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, found = np.zeros(2, np.int64), np.zeros((2, 1 << bits), np.int32)
        for batch in batches:
            for part in slices(batch, "text"):
                flat, first = document_features(part.column("text"), bits)
                side = part.column("side").to_numpy()
                for row, a, b in zip(side.tolist(), first, first[1:]):
                    found[row, np.unique(flat[a:b])] += 1
                n += np.bincount(side, minlength=2)
        yield pa.RecordBatch.from_arrays([pa.array([0, 1]), pa.array(n), pa.array([x.tobytes() for x in found])],
                                         ["side", "n", "found"])

    n, found = np.zeros(2, np.int64), np.zeros((2, 1 << bits), np.int64)
    for row in sample.coalesce(8).mapInArrow(count, "side long, n long, found binary").toLocalIterator():
        n[row["side"]] += row["n"]
        found[row["side"]] += np.frombuffer(row["found"], np.int32)
    if not n.all():
        return None
    chosen = select_features(found[1], n[1], found[0], n[0], prior)
    column = np.full(1 << bits, -1, np.int64)
    column[chosen] = np.arange(len(chosen))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                flat, first = document_features(part.column("text"), bits)
                has = [np.unique(x[x >= 0]).astype(np.uint32).tobytes()
                       for x in (column[flat[a:b]] for a, b in zip(first, first[1:]))]
                yield pa.RecordBatch.from_arrays([part.column("side"), pa.array(has, pa.binary())], ["side", "has"])

    rows = sorted((r["side"], bytes(r["has"])) for r in sample.mapInArrow(pick, "side int, has binary").toLocalIterator())
    sides = []
    for side in (0, 1):
        has = [x for k, x in rows if k == side]
        x = np.zeros((len(has), len(chosen)), np.float32)
        for k, b in enumerate(has):
            x[k, np.frombuffer(b, np.uint32)] = 1
        sides.append(x)
    w, bias = fit_nnpu(sides[1], sides[0], prior)
    weights = np.zeros(1 << bits, np.float32)
    weights[chosen] = w
    return Model(weights, bias, bits)


def score_toxicity(docs: DataFrame, model: Model | None, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with ``score_col``, the probability that a text is toxic.  A
    column of that name is replaced."""
    docs = docs.drop(score_col)
    if model is None:
        return docs.withColumn(score_col, F.lit(0.0))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**bits numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in slices(batch, "_text"):
                v = vocabulary(part.column("_text"))
                f, first = _word_features(v, m.bits)
                used = np.flatnonzero(m.weights[f])
                f, first = f[used], np.searchsorted(used, first)
                flat, begin = _spread(v, f, first)
                doc = np.repeat(np.arange(part.num_rows), np.diff(begin))
                pair = np.unique((doc << m.bits) | flat)
                z = np.bincount(pair >> m.bits, m.weights[pair & ((1 << m.bits) - 1)], part.num_rows) + m.bias
                score = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
                yield pa.RecordBatch.from_arrays([part.column("_row"), pa.array(score, pa.float64())], ["_row", "_score"])

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
                       F.col(f"`{text_col}`").alias("_text"))
    return rows.mapInArrow(run, rows.select("_row").schema.add("_score", "double")) \
        .select(*[F.col("_row").getField(c).alias(c) for c in docs.columns], F.col("_score").alias(score_col))


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    """One row per document: its fold, score and prediction."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = train(docs, labels)
    keep = docs.withColumn("held_out", F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False)))
    return score_toxicity(keep, model).select(
        "doc_id", "held_out", "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
