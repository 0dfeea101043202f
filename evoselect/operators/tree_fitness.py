"""Batched fitness: depth-2 gini trees for a whole population (J3, ML1-ML4, A1-A3).

The fitness of an individual is the hold-out accuracy of a depth-2 gini
tree per feature block, restricted to the block's selected features, and
averaged over blocks.  The reference fits 4 models per individual, one
application each.  Here one plan scores the whole population:

1. the root's split sums once per run (one pass over the data);
2. best threshold per feature at the root -> each (individual, block) takes
   the best of its selected features (a join of genes with a per-feature
   table, no data pass);
3. the children's split sums only for the *distinct* root features chosen (at
   most one per feature; one pass over the data for all of them);
4. from these, once per root: the best split of every
   (child node, feature) with the correct test rows of its two leaves, and
   the correct test rows of the node kept as a leaf;
5. per (individual, block, side) the best of its features' splits -- a join
   of genes with those tables; test rows are never routed per individual.

Classes of ordinary size are counted whole in a task (``class_splits``); those
beyond ``LARGE_CLASS`` through histograms, whose cells per class are few then.

Everything after the two passes works on tables of size
population x features.  Accuracy is exact: sum of correct test rows over
blocks divided by (blocks x test rows), one division, stored as double: two different numbers of correct rows never tie.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, scratch_path
from ..sources.datasets import LabeledTable
from .binning import BinSpec, binned_rows, fit_bins, fit_quantile_bins, fit_stride_bins
from .class_splits import class_sums
from .histogram import Block, child_histogram, root_histogram, root_passes
from .splits import add_bin_sums, best_of, best_splits, bin_sums, candidates_of, majority, next_train_bins


#: tasks that the rows of one class are spread over, at least; one more for so many rows
CLASS_SALTS, SALT_ROWS = 16, 1_000_000
#: rows, and values (rows x features), beyond which a class is counted in several tasks
LARGE_CLASS, LARGE_VALUES = 100_000, 20_000_000
#: cells (root, feature, bin, side) that a task keeps sums of at once
SUM_CELLS = 2_000_000


@dataclass
class TreeData:
    """Everything about the dataset the scorer needs, built once per run."""
    rows: DataFrame                # y, is_test, bins, large (the class is beyond ``LARGE_CLASS``)
    large_hist: DataFrame | None   # root histogram of the large classes, if there are any
    workdir: str | None
    thresholds: DataFrame
    root_best: DataFrame
    spec: BinSpec
    n_features: int
    block_size: int
    n_test: int
    root_correct: int

    @property
    def binned(self) -> DataFrame:
        return self.rows.select("y", "is_test", F.col("bins").cast("array<int>").alias("bins"))

    @cached_property
    def root_hist(self) -> DataFrame:
        """Root histogram of all classes, built when first asked for."""
        hist = root_histogram(self.binned, self.spec.n_bins + 1)
        return _kept(hist, self.workdir, "root_hist")

    @property
    def n_blocks(self) -> int:
        return -(-self.n_features // self.block_size)


def prepare(table: LabeledTable, block_size: int, n_bins: int = 32,
            workdir: str | None = "auto", borders: str = "widths") -> TreeData:
    """Bin the table (``borders``: equal "widths", "quantiles", or the "strides"
    of pyspark.ml's tree) and build the root statistics.

    The binned rows and root tables are written under ``workdir`` (default: a
    fresh folder below ``spark.checkpoint.dir``; ``None`` keeps them lazy) and
    read back: later passes start from the compact table
    and the lineage is cut, so a lost executor re-reads files instead of
    recomputing the source.
    """
    spark: SparkSession = table.df.sparkSession
    if workdir == "auto":
        workdir = scratch_path(spark, "tree_data")
    spec = {"widths": fit_bins, "quantiles": fit_quantile_bins, "strides": fit_stride_bins}[borders](table, n_bins)
    most = min(LARGE_CLASS, max(1, LARGE_VALUES // max(1, table.n_features)))
    # at most one class in ``most`` rows
    large = _kept(table.df.groupBy(F.col("label").alias("large_y")).agg(F.count(F.lit(1)).alias("n"))
                  .where(F.col("n") > most).select("large_y"), workdir, "large")
    some_large = large.limit(1).count() > 0
    small = "tinyint" if n_bins < 127 else "int"
    binned = binned_rows(table, spec).select("y", "is_test", F.col("bins").cast(f"array<{small}>").alias("bins"))
    rows = binned.join(F.broadcast(large), F.col("y").eqNullSafe(F.col("large_y")), "left_semi").withColumn("large", F.lit(True)) \
        .unionByName(binned.join(F.broadcast(large), F.col("y").eqNullSafe(F.col("large_y")), "left_anti")
                     .withColumn("large", F.lit(False))) if some_large else binned.withColumn("large", F.lit(False))
    if workdir:
        # clustered by class once (large ones salted, one may hold most rows): a
        # histogram pass then meets few classes in a task, so its map-side
        # aggregate collapses them however many classes there are
        salts = max(CLASS_SALTS, spec.rows // SALT_ROWS)
        # by row number: equal rows spread too
        salt = F.when(F.col("large"), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(salts))).otherwise(0)
        rows = rows.withColumn("_salt", salt).repartition(F.col("y"), F.col("_salt")).sortWithinPartitions("y").drop("_salt")
    rows = _kept(rows, workdir, "binned")
    cells = n_bins + 1
    sums = _kept(class_sums(rows.where("NOT large"), [Block(0, None, (-1,), (0,))], cells, table.n_features, spec.rows),
                 workdir, "root_sums")
    large_hist = _kept(root_histogram(rows.where("large"), cells), workdir, "root_hist_large") if some_large else None
    per_bin = _bins_of(sums, large_hist)
    thresholds = _kept(next_train_bins(per_bin.withColumnRenamed("c", "n_train")), workdir, "thresholds")
    root_best = _kept(best_of(candidates_of(per_bin, thresholds)).select("f", "t", "score"), workdir, "root_best")
    n_test = sums.where("side = -1 AND f = 0").select("n_test")
    root_node = sums.where((F.col("side") == 0) & (F.col("f") == 0) & (F.col("upto") == n_bins)).select(*_LEADERS)
    if large_hist is not None:
        n_test = n_test.unionByName(large_hist.where("f = 0").select("n_test"))
        root_node = root_node.unionByName(_leaders(large_hist.where("f = 0"), ["node"]))
    totals = majority(root_node, ["node"]).crossJoin(n_test.agg(F.sum("n_test").alias("n_all"))).first()
    n_test, root_correct = (int(totals["n_all"]), int(totals["correct"])) if totals else (0, 0)
    return TreeData(rows, large_hist, workdir, thresholds, root_best, spec, table.n_features,
                    block_size, n_test, root_correct)


_LEADERS = ("node", "y", "n_train", "n_test")


def _kept(df: DataFrame, workdir: str | None, name: str) -> DataFrame:
    """``df`` written to ``workdir`` and read back; as it is without one."""
    if not workdir:
        return df
    df.write.mode("overwrite").parquet(f"{workdir}/{name}")
    return df.sparkSession.read.parquet(f"{workdir}/{name}")


def _bins_of(sums: DataFrame, large_hist: DataFrame | None) -> DataFrame:
    """``bin_sums`` over all classes: from ``class_sums`` and the large ones' histogram."""
    cols = ("node", "f", "b", "c", "d_left", "d_right", "sq_total")
    parts = sums.where("side = -1 AND n_train > 0").withColumnRenamed("n_train", "c").select(*cols)
    if large_hist is not None:
        exact = [F.col(c).cast("decimal(38,0)").alias(c) for c in ("d_left", "d_right", "sq_total")]
        parts = parts.select(*cols[:4], *exact).unionByName(bin_sums(large_hist))
    return add_bin_sums(parts)


def _leaders(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a node's classes: (*keys, y, n_train, n_test)."""
    return cells.groupBy(*keys, "y").agg(F.sum("n_train").alias("n_train"), F.sum("n_test").alias("n_test"))


def genes(population: DataFrame, block_size: int) -> DataFrame:
    """(individual_id, f, block) for every selected feature."""
    return population.select("individual_id", F.posexplode("genome").alias("f", "bit")) \
        .where("bit = 1") \
        .select("individual_id", "f", F.floor(F.col("f") / block_size).cast("int").alias("block"))


def root_choices(data: TreeData, gene_df: DataFrame) -> DataFrame:
    """(individual_id, block, r, t_r): best useful root split among the
    individual's features of the block; absent when none is useful."""
    cand = gene_df.join(data.root_best, "f")
    best = F.min_by(F.struct("f", "t"), F.struct(-F.col("score"), "f"))
    return cand.groupBy("individual_id", "block").agg(best.alias("b")) \
        .select("individual_id", "block", F.col("b.f").alias("r"), F.col("b.t").alias("t_r"))


def needed_roots(choices: DataFrame) -> DataFrame:
    """Distinct root splits (at most one row per feature)."""
    return choices.select("r", "t_r", "block").distinct()


def child_tables(data: TreeData, child_hist: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per-root statistics that no individual changes, from a child histogram.

    * ``best`` (node, f, t, score, correct): the best useful split of each
      (child node, feature) and the correct test rows of its two leaves;
    * ``nodes`` (node, correct): correct test rows when the node stays a leaf.

    An individual's child split is always some feature's best split, so these
    two tables hold every leaf a tree can have; scoring a generation is then
    only joins of genes against them.
    """
    best = best_splits(child_hist, data.thresholds)
    cells = child_hist.join(best.select("node", "f", "t"), ["node", "f"]) \
        .withColumn("side", (F.col("b") > F.col("t")).cast("int")) \
        .groupBy("node", "f", "side", "y") \
        .agg(F.sum("n_train").alias("n_train"), F.sum("n_test").alias("n_test"))
    split_correct = majority(cells, ["node", "f", "side"]) \
        .groupBy("node", "f").agg(F.sum("correct").alias("correct"))
    # class totals of a node: any one feature's histogram covers all its rows
    node_cells = child_hist.where(F.col("f") == F.floor(F.col("node") / 2)) \
        .groupBy("node", "y").agg(F.sum("n_train").alias("n_train"), F.sum("n_test").alias("n_test"))
    nodes = majority(node_cells, ["node"]).select("node", "correct")
    return best.join(split_correct, ["node", "f"]), nodes


def child_statistics(data: TreeData, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``child_tables`` of the given root splits (r, t_r, block), no histogram of
    all classes between."""
    n_bins = data.spec.n_bins + 1
    sums = None
    for blocks in root_passes(roots, data.block_size, data.n_features, n_bins, SUM_CELLS):
        found = class_sums(data.rows.where("NOT large"), blocks, n_bins, data.n_features, data.spec.rows)
        sums = found if sums is None else sums.unionByName(found)
    sums = materialize(sums, "child_sums")
    hist = None if data.large_hist is None else materialize(child_histogram(
        data.rows.where("large").select("y", "is_test", "bins"), roots, data.block_size, data.n_features,
        data.large_hist, n_bins), "child_hist")
    best = materialize(best_of(candidates_of(_bins_of(sums, hist), data.thresholds)), "child_best")
    own = F.col("f") == F.floor(F.col("node") / 2)
    # the top class among those of each task, then of all
    split = sums.where("side >= 0").join(F.broadcast(best.select("node", "f", "t")), ["node", "f"]) \
        .where("t BETWEEN b AND upto").select("node", "f", "side", "y", "n_train", "n_test")
    leaf = sums.where((F.col("side") == 0) & (F.col("upto") == data.spec.n_bins) & own).select(*_LEADERS)
    if hist is not None:
        split = split.unionByName(_leaders(
            hist.join(best.select("node", "f", "t"), ["node", "f"]).withColumn("side", (F.col("b") > F.col("t")).cast("int")),
            ["node", "f", "side"]))
        leaf = leaf.unionByName(_leaders(hist.where(own), ["node"]))
    split_correct = majority(split, ["node", "f", "side"]).groupBy("node", "f").agg(F.sum("correct").alias("correct"))
    return best.join(split_correct, ["node", "f"]), majority(leaf, ["node"]).select("node", "correct")


def score_population(data: TreeData, population: DataFrame,
                     child_best: DataFrame | None = None,
                     node_correct: DataFrame | None = None) -> DataFrame:
    """(individual_id, correct, n_blocks_used, fitness) for every individual.

    ``child_best`` / ``node_correct`` come from :func:`child_tables` (the
    search loop keeps them per root feature); when absent they are built for
    the roots this population needs.  Fitness is NULL when some block has no
    selected feature (no tree can be fit there) or there are no test rows.
    """
    # both are read by several joins below: written once
    g = materialize(genes(population, data.block_size), "genes")
    roots = materialize(root_choices(data, g), "roots")
    if child_best is None or node_correct is None:
        child_best, node_correct = child_statistics(data, needed_roots(roots))

    sides = roots.select("individual_id", "block", "r",
                         F.explode(F.array(F.lit(0), F.lit(1))).alias("s")) \
        .withColumn("node", F.col("r") * 2 + F.col("s"))
    cand = sides.join(g, ["individual_id", "block"]) \
        .join(child_best.select("node", "f", "score", "correct"), ["node", "f"])
    chosen = cand.groupBy("individual_id", "block", "s").agg(
        F.min_by("correct", F.struct(-F.col("score"), "f")).alias("split_correct"))
    # a side without a useful split is a leaf: the node's own majority
    per_side = sides.join(chosen, ["individual_id", "block", "s"], "left") \
        .join(node_correct.select("node", F.col("correct").alias("leaf_correct")), "node", "left") \
        .select("individual_id", "block",
                F.coalesce("split_correct", "leaf_correct").alias("correct"))
    with_root = per_side.groupBy("individual_id", "block").agg(F.sum("correct").alias("correct"))
    # a block without a useful root split is one leaf: the overall majority
    leaf_root = g.select("individual_id", "block").distinct() \
        .join(roots, ["individual_id", "block"], "left_anti") \
        .select("individual_id", "block", F.lit(data.root_correct).cast("bigint").alias("correct"))
    per_ind = with_root.unionByName(leaf_root).groupBy("individual_id").agg(
        F.sum("correct").alias("correct"), F.count("*").alias("n_blocks_used"))
    denom = data.n_blocks * data.n_test
    fitness = F.when((F.col("n_blocks_used") == data.n_blocks) & F.lit(denom > 0),
                     F.col("correct").cast("double") / F.lit(float(max(denom, 1))))
    return population.select("individual_id").join(per_ind, "individual_id", "left").select(
        "individual_id",
        F.coalesce("correct", F.lit(0)).cast("bigint").alias("correct"),
        F.coalesce("n_blocks_used", F.lit(0)).cast("int").alias("n_blocks_used"),
        fitness.cast("double").alias("fitness"),
    )
