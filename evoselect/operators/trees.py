"""Fitted trees as a table, and rows routed through them (ML3, P12).

``fitted_trees`` has one row per (individual, block): the root split, each
child's split (NULL where the child is a leaf) and the classes of the leaves.
Together they are the node table of every tree of a population; it is read off
the histograms that scored it, no data row is visited.

``tree_predictions`` routes rows through all trees of their block by
comparisons of bins.  A row meets the trees of a block in a join on the block,
whose tree side is broadcast in chunks of ``TREES`` rows: it is as large as the
population, never as the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from ..sources.datasets import LabeledTable
from . import tree_fitness as tf
from .binning import bin_features
from .histogram import child_histogram
from .splits import best_splits, majority

#: trees that one broadcast holds (some 200 bytes each)
TREES = 100_000


def leaf_tables(data: tf.TreeData, child_hist: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, f, t, score, left_class, right_class) of the best useful split of
    each (child node, feature), and (node, leaf_class) of each child node."""
    best = materialize(best_splits(child_hist, data.thresholds), "child_best")
    cells = child_hist.join(best.select("node", "f", "t"), ["node", "f"]) \
        .withColumn("side", (F.col("b") > F.col("t")).cast("int")) \
        .groupBy("node", "f", "side", "y").agg(F.sum("n_train").alias("n_train"), F.sum("n_test").alias("n_test"))
    sides = majority(cells, ["node", "f", "side"]).groupBy("node", "f").agg(
        F.max(F.when(F.col("side") == 0, F.col("pred"))).alias("left_class"),
        F.max(F.when(F.col("side") == 1, F.col("pred"))).alias("right_class"))
    # class totals of a node: any one feature's histogram covers all its rows
    whole = child_hist.where(F.col("f") == F.floor(F.col("node") / 2)) \
        .groupBy("node", "y").agg(F.sum("n_train").alias("n_train"), F.sum("n_test").alias("n_test"))
    return best.join(sides, ["node", "f"]), majority(whole, ["node"]).select("node", F.col("pred").alias("leaf_class"))


def fitted_trees(data: tf.TreeData, population: DataFrame) -> DataFrame:
    """(individual_id, block, root, children): ``root`` is (f, t) or NULL,
    ``children`` an array of two (f, t, left_class, right_class, leaf_class), the left
    child first; without a root split it holds one leaf.  An empty block has
    no tree."""
    g = materialize(tf.genes(population, data.block_size), "genes")
    roots = materialize(tf.root_choices(data, g), "roots")
    hist = materialize(child_histogram(data.binned, tf.needed_roots(roots), data.block_size, data.n_features,
                                       data.root_hist, data.spec.n_bins + 1), "child_hist")
    splits, leaves = leaf_tables(data, hist)
    sides = roots.select("individual_id", "block", F.struct(F.col("r").alias("f"), F.col("t_r").alias("t")).alias("root"),
                         F.explode(F.array(F.lit(0), F.lit(1))).alias("s")) \
        .withColumn("node", F.col("root.f") * 2 + F.col("s"))
    chosen = sides.join(g, ["individual_id", "block"]).join(splits, ["node", "f"]) \
        .groupBy("individual_id", "block", "s").agg(
            F.min_by(F.struct("f", "t", "left_class", "right_class"), F.struct(-F.col("score"), "f")).alias("c"))
    child = F.struct("s", F.col("c.f").alias("f"), F.col("c.t").alias("t"), F.col("c.left_class").alias("left_class"),
                     F.col("c.right_class").alias("right_class"), "leaf_class")
    deep = sides.join(chosen, ["individual_id", "block", "s"], "left").join(leaves, "node", "left") \
        .groupBy("individual_id", "block").agg(F.first("root").alias("root"), F.array_sort(F.collect_list(child)).alias("children"))
    # a block without a useful root split is one leaf
    top = data.root_hist.where("f = 0").groupBy("node", "y") \
        .agg(F.sum("n_train").alias("n_train"), F.sum("n_test").alias("n_test"))
    kinds = {f.name: f.dataType for f in deep.schema["children"].dataType.elementType}
    leaf = F.array(F.struct(F.lit(0).alias("s"), *[
        (F.col("pred") if n == "leaf_class" else F.lit(None).cast(kinds[n])).alias(n) for n in kinds if n != "s"]))
    flat = g.select("individual_id", "block").distinct().join(roots, ["individual_id", "block"], "left_anti") \
        .withColumn("node", F.lit(-1)).join(majority(top, ["node"]), "node") \
        .select("individual_id", "block", F.lit(None).cast(deep.schema["root"].dataType).alias("root"), leaf.alias("children"))
    return materialize(deep.unionByName(flat), "trees")


def route(bins: Column, root: Column, children: Column, first: Column) -> Column:
    """The class of the leaf that a row falls into; ``bins`` are those of the
    block, whose first feature is ``first``."""
    def below(f: Column, t: Column) -> Column:
        return F.element_at(bins, (f - first + 1).cast("int")) <= t
    side = F.when(root.isNull() | below(root["f"], root["t"]), 0).otherwise(1)
    child = F.element_at(children, side + 1)
    return F.when(child["f"].isNull(), child["leaf_class"]) \
        .when(below(child["f"], child["t"]), child["left_class"]).otherwise(child["right_class"])


def tree_predictions(table: LabeledTable, data: tf.TreeData, trees: DataFrame, test_only: bool = True) -> DataFrame:
    """(row_key, y, individual_id, block, predicted) of every test row (or every
    row) and tree."""
    rows = table.df.where("is_test") if test_only else table.df
    size = data.block_size
    blocks = F.transform(F.sequence(F.lit(0), F.lit(data.n_blocks - 1)),
                         lambda k: F.slice("bins", k * size + 1, F.lit(size)))
    slices = rows.select("row_key", F.col("label").alias("y"), bin_features(F.col("features"), data.spec).alias("bins")) \
        .select("row_key", "y", F.posexplode(blocks).alias("block", "bins"))
    n = trees.count()
    chunks = -(-n // TREES) or 1
    out = None
    for k in range(chunks):
        some = trees if chunks == 1 else trees.where(F.pmod(F.xxhash64("individual_id", "block"), F.lit(chunks)) == k)
        said = slices.join(F.broadcast(some), "block").select(
            "row_key", "y", "individual_id", "block",
            route(F.col("bins"), F.col("root"), F.col("children"), F.col("block") * size).alias("predicted"))
        out = said if out is None else out.unionByName(said)
    return out
