"""Gaussian naive Bayes for a whole population.

A third model behind the contract "genome in, accuracy out".  Its sufficient
statistics, (rows, mean, variance) per class and feature, do not depend on the
genome: one aggregate over the training rows serves every model of every
generation.  Scoring a population is one pass over the test rows: a row's
log-likelihood per (feature, class) is computed once and added up over the
features that each model has selected.

Class c scores log(share of its training rows) plus, for each selected feature,
the log density of a normal distribution with the class's mean and its variance
(over n) plus ``SMOOTHING``.  NULL, NaN and infinite values are left out of the
statistics and of the sums; a class without a value of a feature counts as mean
0, variance 0 there.  Equal scores go to the lower class.  Rows without a label take no
part.  Fitness is NULL when a block has no selected feature, or without
training or test rows.
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

SMOOTHING = 1e-9
#: numbers that a task holds at once for (rows x features or models x classes)
CELLS = 2_000_000


@dataclass
class BayesData:
    test: DataFrame             # y int (-1: no training class), x array<double>
    prior: np.ndarray           # (classes)
    mean: np.ndarray            # (features, classes)
    variance: np.ndarray
    n_features: int
    block_size: int
    n_test: int

    @property
    def n_blocks(self) -> int:
        return -(-self.n_features // self.block_size)


def prepare_naive_bayes(table: LabeledTable, block_size: int) -> BayesData:
    """The statistics, once per run: one row per class and feature reaches the driver."""
    spark = table.df.sparkSession
    rows = table.df.where(F.col("label").isNotNull())
    train = rows.where(~F.col("is_test"))
    counts = {r["label"]: r["count"] for r in train.groupBy("label").count().orderBy("label").collect()}
    classes = sorted(counts)
    number = {c: k for k, c in enumerate(classes)}
    finite = ~F.isnan("v") & (F.abs("v") < float("inf"))
    stats = train.select("label", F.posexplode("features").alias("f", "v")).where(finite) \
        .groupBy("label", "f").agg(F.avg("v").alias("m"), F.var_pop("v").alias("s")).collect()
    mean, variance = np.zeros((2, table.n_features, len(classes)))
    for r in stats:
        mean[r["f"], number[r["label"]]], variance[r["f"], number[r["label"]]] = r["m"], r["s"]
    names = spark.createDataFrame([(k, c) for c, k in number.items()], rows.select(F.lit(0).alias("y"), "label").schema)
    test = materialize(rows.where("is_test").join(names, "label", "left")
                       .select(F.coalesce("y", F.lit(-1)).alias("y"), F.col("features").alias("x")), "bayes_test")
    total = max(1, sum(counts.values()))
    return BayesData(test, np.array([counts[c] / total for c in classes]), mean, variance + SMOOTHING,
                     table.n_features, block_size, test.count())


def score_population_naive_bayes(data: BayesData, population: DataFrame) -> DataFrame:
    """(individual_id, correct, fitness) of every individual."""
    spark, size, k = population.sparkSession, data.block_size, len(data.prior)
    genomes = {r["individual_id"]: np.array(r["genome"], float)
               for r in population.select("individual_id", "genome").collect()}       # population-sized
    subsets = sorted({(b, tuple(g[b * size:(b + 1) * size])) for g in genomes.values() for b in range(data.n_blocks)})
    subsets = [s for s in subsets if any(s[1])]
    number = {s: n for n, s in enumerate(subsets)}
    groups = {b: [n for n, s in enumerate(subsets) if s[0] == b] for b in {s[0] for s in subsets}}
    masks = {b: np.array([subsets[n][1] for n in ns]).T for b, ns in groups.items()}
    prior, mean, variance, width = data.prior, data.mean, data.variance, data.n_features

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        right = np.zeros(len(subsets), np.int64)
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            y = batch.column("y").to_numpy()
            for b, ns in groups.items():
                at = slice(b * size, min(width, (b + 1) * size))
                step = max(1, CELLS // (k * max(len(ns), size)))
                for lo in range(0, len(x), step):
                    v = x[lo:lo + step, at, None]
                    known = np.isfinite(v)
                    density = -0.5 * (np.log(2 * np.pi * variance[at]) + (np.where(known, v, 0) - mean[at]) ** 2 / variance[at])
                    score = np.einsum("nfk,fm->nmk", np.where(known, density, 0), masks[b]) + np.log(prior)
                    right[ns] += (score.argmax(2) == y[lo:lo + step, None]).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(right))), pa.array(right)], ["model", "right"])

    right = {}
    if k and data.n_test and subsets:
        right = {r["model"]: r["n"] for r in data.test.mapInArrow(run, "model long, right long")
                 .groupBy("model").agg(F.sum("right").alias("n")).collect()}
    out = []
    for ind, g in sorted(genomes.items()):
        own = [right[n] for b in range(data.n_blocks)
               if (n := number.get((b, tuple(g[b * size:(b + 1) * size])), -1)) in right]
        whole = data.n_blocks > 0 and len(own) == data.n_blocks
        out.append((ind, sum(own), sum(own) / (data.n_blocks * data.n_test) if whole else None))
    return spark.createDataFrame(out, "individual_id bigint, correct bigint, fitness double")
