"""Gini split search on sparse histograms (ML1b) and leaf majority (ML1c).

For a node with class counts p_y (n rows) and a threshold with left/right
counts l_y / r_y, the gini gain is

    gain = (sum l^2 / n_L + sum r^2 / n_R - sum p^2 / n) / n

so the best threshold maximises ``score = sum l^2 / n_L + sum r^2 / n_R``
and a split is useful only when ``score > sum p^2 / n``.  The running sums
of squares are built from *seen* cells only: moving a cell of count ``c``
(class count ``l`` left of it) to the left adds ``c(2l + c)`` to sum l^2 and
``c(c - 2r)`` to sum r^2.  No dense class x threshold array is formed, so
many classes cost only the cells that occur.  Sums are exact (decimal(38,0)).

Thresholds follow MLlib's continuous splits: candidates are midpoints
between consecutive distinct training values of the feature (over the
whole training set); a node uses the lowest candidate that gives its best
partition.  Ties: larger score, then lower threshold; across features the
lower feature index; majority class: larger count, then lower label.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# relative margin below which a gain counts as zero (rounding of equal ratios)
GAIN_EPS = 1e-12
_DEC = "decimal(38,0)"


def next_train_bins(root_hist: DataFrame) -> DataFrame:
    """(f, b, t): for each distinct training bin ``b`` of feature ``f`` the
    split threshold between it and the next distinct training bin."""
    seen = root_hist.where("n_train > 0").select("f", "b").distinct()
    w = Window.partitionBy("f").orderBy("b")
    nxt = F.lead("b").over(w)
    return seen.select("f", "b", F.floor((F.col("b") + nxt) / 2).cast("int").alias("t")) \
        .where(F.col("t").isNotNull())


def bin_sums(hist: DataFrame) -> DataFrame:
    """(node, f, b, c, d_left, d_right, sq_total): training rows of a bin and what
    moving it to the left adds to sum l^2 and sum r^2; ``sq_total`` adds up to
    sum p^2 over the bins of a (node, f).

    One shuffle on (node, f) serves the windows and the per-bin aggregate.
    """
    cells = hist.where("n_train > 0").select("node", "f", "b", "y", F.col("n_train").alias("c")) \
        .repartition("node", "f")
    c = F.col("c").cast(_DEC)
    w_cls = Window.partitionBy("node", "f", "y").orderBy("b")
    l_before = F.coalesce(F.sum("c").over(w_cls.rowsBetween(Window.unboundedPreceding, -1)),
                          F.lit(0)).cast(_DEC)
    tot = F.sum("c").over(Window.partitionBy("node", "f", "y")).cast(_DEC)
    per_cell = cells.select(
        "node", "f", "b", "c",
        (c * (F.lit(2) * l_before + c)).cast(_DEC).alias("d_left"),
        (c * (c - F.lit(2) * (tot - l_before))).cast(_DEC).alias("d_right"),
        F.when(l_before == 0, tot * tot).otherwise(F.lit(0)).cast(_DEC).alias("sq_total"),
    )
    return add_bin_sums(per_cell)


def add_bin_sums(parts: DataFrame) -> DataFrame:
    """``bin_sums`` from sums over different classes."""
    return parts.groupBy("node", "f", "b").agg(
        F.sum("c").alias("c"), *[F.sum(F.col(k).cast(_DEC)).cast(_DEC).alias(k) for k in ("d_left", "d_right", "sq_total")])


def split_candidates(hist: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Every usable threshold of every (node, f): score and gain test."""
    return candidates_of(bin_sums(hist), thresholds)


def candidates_of(per_bin: DataFrame, thresholds: DataFrame) -> DataFrame:
    """``split_candidates`` from ``bin_sums``."""
    w_f = Window.partitionBy("node", "f")
    w_run = w_f.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    run = per_bin.select(
        "node", "f", "b",
        F.sum("c").over(w_run).alias("n_left"),
        F.sum("c").over(w_f).alias("n_node"),
        F.sum("d_left").over(w_run).alias("sl2"),
        (F.sum("sq_total").over(w_f) + F.sum("d_right").over(w_run)).alias("sr2"),
        F.sum("sq_total").over(w_f).alias("sp2"),
    )
    n_right = F.col("n_node") - F.col("n_left")
    scored = run.where(n_right > 0).select(
        "node", "f", "b", "n_left", n_right.alias("n_right"),
        (F.col("sl2").cast("double") / F.col("n_left").cast("double")
         + F.col("sr2").cast("double") / n_right.cast("double")).alias("score"),
        (F.col("sp2").cast("double") / F.col("n_node").cast("double")).alias("parent"),
    )
    useful = (F.col("score") - F.col("parent")) > F.lit(GAIN_EPS) * F.col("parent")
    return scored.join(thresholds, ["f", "b"]) \
        .select("node", "f", "t", "n_left", "n_right", "score", useful.alias("useful"))


def best_splits(hist: DataFrame, thresholds: DataFrame) -> DataFrame:
    """(node, f, t, score): the best useful threshold of each (node, feature)."""
    return best_of(split_candidates(hist, thresholds))


def best_of(candidates: DataFrame) -> DataFrame:
    """``best_splits`` from ``split_candidates``."""
    best = F.min_by(F.struct("t", "score"), F.struct(-F.col("score"), "t"))
    return candidates.where("useful").groupBy("node", "f").agg(best.alias("b")).select("node", "f", "b.t", "b.score")


def majority(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Per group of ``keys``: majority class by training count (ties: lowest
    label) and the number of test rows of that class (= correct predictions)."""
    top = F.min_by(F.struct("y", "n_test"), F.struct(-F.col("n_train"), "y"))
    return counts.groupBy(*keys).agg(top.alias("m")) \
        .select(*keys, F.col("m.y").alias("pred"), F.col("m.n_test").alias("correct"))
