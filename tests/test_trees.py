import random
from collections import Counter

import pytest
from evoselect.operators import histogram as hs
from evoselect.operators import tree_fitness as tf
from evoselect.operators import trees as tr
from evoselect.operators.binning import fit_stride_bins
from evoselect.operators.ml_fitness import prepare_ml, score_population_ml
from evoselect.operators.population import init_population
from evoselect.sources.datasets import LabeledTable, embeddings_table, wide_table
from pyspark.sql import functions as F
from sf_dirs import SF_SMALL


def table(spark, columns):
    rows = [(str(k), k % 2, k % 5 == 0, list(map(float, v))) for k, v in enumerate(zip(*columns))]
    df = spark.createDataFrame(rows, "row_key string, label int, is_test boolean, features array<double>")
    return LabeledTable(df, tuple(f"f{k}" for k in range(len(columns))))


def strides(values, n_bins=32):
    """The borders, walking over the sorted values once."""
    counts = sorted(Counter(values).items())
    if len(counts) <= n_bins:
        return [(a + b) / 2 for (a, _), (b, _) in zip(counts, counts[1:])]
    out, upto, target = [], counts[0][1], len(values) / n_bins
    for (a, _), (b, n) in zip(counts, counts[1:]):
        before, upto = upto, upto + n
        if abs(before - target) < abs(upto - target):
            out.append((a + b) / 2)
            target += len(values) / n_bins
    return out


@pytest.mark.parametrize("range_values", [1_000_000, 40])
def test_stride_borders(spark, range_values):
    rng = random.Random(1)
    n = 1500
    columns = [[rng.gauss(0, 1) for _ in range(n)], [rng.randrange(500) ** 2 for _ in range(n)], [rng.randrange(20) for _ in range(n)],
               [0 if rng.random() < 0.6 else rng.gauss(0, 1) for _ in range(n)], [7.0] * n,
               [rng.choice([1, 2, 3, rng.randrange(100)]) for _ in range(n)], [-0.0 if k % 3 else k for k in range(n)]]
    t = table(spark, columns)
    got = fit_stride_bins(t, 32, range_values).cuts
    for f, c in enumerate(columns):
        assert list(got[f]) == pytest.approx(strides([x + 0.0 for k, x in enumerate(c) if k % 5]), abs=0), f


def test_trees_on_raw_columns_equal_pyspark_ml(spark):
    t = embeddings_table(spark, SF_SMALL, 42)
    pop = init_population(spark, 3, t.n_features, 42)
    data = tf.prepare(t, 16, borders="strides")
    theirs = {r["individual_id"]: r["correct"] for r in score_population_ml(prepare_ml(t), pop, 16, "tree").collect()}
    assert {r["individual_id"]: r["correct"] for r in tf.score_population(data, pop).collect()} == theirs


def test_predictions_have_the_fitness(spark):
    t = embeddings_table(spark, SF_SMALL, 42)
    pop = init_population(spark, 5, t.n_features, 42)
    data = tf.prepare(t, 16)
    fitness = {r["individual_id"]: r["correct"] for r in tf.score_population(data, pop).collect()}
    said = tr.tree_predictions(t, data, tr.fitted_trees(data, pop))
    right = said.groupBy("individual_id").agg(F.sum((F.col("y") == F.col("predicted")).cast("int")).alias("n")).collect()
    assert {r["individual_id"]: r["n"] for r in right} == fitness
    assert said.count() == 5 * data.n_blocks * data.n_test


def test_predictions_in_chunks_and_without_splits(spark, monkeypatch):
    t = table(spark, [[1.0] * 60, [2.0] * 60, [k % 2 for k in range(60)], [k % 3 for k in range(60)]])
    pop = spark.createDataFrame([(0, [1, 1, 1, 1]), (1, [1, 0, 0, 1]), (2, [0, 0, 1, 0])], "individual_id long, genome array<int>")
    data = tf.prepare(t, 2)
    want = sorted(map(tuple, tr.tree_predictions(t, data, tr.fitted_trees(data, pop)).collect()))
    monkeypatch.setattr(tr, "TREES", 2)
    assert sorted(map(tuple, tr.tree_predictions(t, data, tr.fitted_trees(data, pop)).collect())) == want
    by_tree = Counter((r[2], r[3]) for r in want)
    assert set(by_tree) == {(0, 0), (0, 1), (1, 0), (1, 1), (2, 1)} and set(by_tree.values()) == {12}
    assert all(r[4] == r[1] for r in want if r[3] == 1 and r[2] == 0)        # feature 2 is the class


# ------------------------------------------------------------------ histograms
def binned(spark, rng, n, width, classes):
    rows = [(rng.choice(classes), rng.random() < 0.2, [rng.randrange(5) for _ in range(width)]) for _ in range(n)]
    rows += [(None, False, [1] * width), (None, True, [1] * width)]
    return rows, spark.createDataFrame(rows, "y string, is_test boolean, bins array<int>").repartition(3)


@pytest.mark.parametrize("big,codes,cells", [(128, 4_000_000, 16_000_000), (1, 50, 16_000_000), (10, 50, 100), (10**9, 100, 10**9)])
def test_counted_cells(spark, monkeypatch, big, codes, cells):
    for name, value in (("BIG_CLASS", big), ("CODES", codes), ("ARRAY_CELLS", cells)):
        monkeypatch.setattr(hs, name, value)
    rng = random.Random(big)
    rows, df = binned(spark, rng, 300, 7, ["a", "a", "a", "b", "c", *map(str, range(40))])
    root = hs.root_histogram(df)
    want = Counter((f, b, y, t) for y, t, x in rows for f, b in enumerate(x))
    got = {(r["f"], r["b"], r["y"], t): n for r in root.collect() for t, n in ((False, r["n_train"]), (True, r["n_test"])) if n}
    assert got == dict(want)
    splits = [(0, 1, 0), (2, 3, 0), (5, 0, 1), (6, 2, 1)]
    roots = spark.createDataFrame(splits, "r int, t_r int, block int")
    child = hs.child_histogram(df, roots, 4, 7, root)
    want = Counter()
    for y, t, x in rows:
        for r, limit, block in splits:
            for f in range(block * 4, min(7, block * 4 + 4)):
                want[2 * r + (x[r] > limit), f, x[f], y, t] += 1
    got = {(r["node"], r["f"], r["b"], r["y"], t): n for r in child.collect()
           for t, n in ((False, r["n_train"]), (True, r["n_test"])) if n}
    assert got == dict(want)


def test_counting_odd_rows(spark):
    df = spark.createDataFrame([("a", False, [1, 2]), ("a", True, [3]), ("b", False, [])], "y string, is_test boolean, bins array<int>")
    got = sorted((r["f"], r["b"], r["y"], r["n_train"], r["n_test"]) for r in hs.root_histogram(df.coalesce(1)).collect())
    assert got == [(0, 1, "a", 1, 0), (0, 3, "a", 0, 1), (1, 2, "a", 1, 0)]
    assert hs.root_histogram(df.limit(0)).collect() == []


def test_wide_table_pads_short_vectors(spark):
    t = wide_table(spark, SF_SMALL)
    assert t.n_features == 760 and t.df.select(F.size("features")).distinct().collect() == [(760,)]
