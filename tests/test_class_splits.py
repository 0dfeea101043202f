"""Split sums by whole classes: same trees as through histograms, no table of all cells."""
import os
import random
import tempfile

import pytest

from evoselect.operators import class_splits as cs
from evoselect.operators import tree_fitness as tf
from evoselect.operators.histogram import child_histogram
from evoselect.operators.population import init_population
from evoselect.operators.splits import best_splits, majority, next_train_bins
from evoselect.sources.datasets import LabeledTable

N = 5


def table(spark, labels, kind, seed=1, test_share=0.3):
    """Rows with values missing, vectors too short or missing, and classes whose values lean to one side."""
    r = random.Random(seed)
    rows = []
    for i, y in enumerate(labels):
        lean = (hash(y) % 7) / 3 if y is not None and y == y else 0.0
        x = [r.choice([None, float("nan")]) if r.random() < 0.03 else float(round(r.gauss(lean * (f % 2), 1), 1)) for f in range(N)]
        x = None if r.random() < 0.02 else x[:3] if r.random() < 0.02 else x
        rows.append((str(i), y, r.random() < test_share, x))
    df = spark.createDataFrame(rows, f"row_key string, label {kind}, is_test boolean, features array<double>")
    return LabeledTable(df.repartition(4), tuple(f"x{f}" for f in range(N)))


def labels_of(kind, n=1500, seed=3):
    r = random.Random(seed)
    if kind == "bigint":
        return [None if r.random() < 0.1 else r.choice([0, 1, 2, r.randrange(400)]) for _ in range(n)]
    if kind == "double":
        return [r.choice([None, float("nan"), 0.0, -0.0, 1.5, 2.5]) for _ in range(n)]
    return [r.choice(["a", "b", None, f"c{r.randrange(200)}"]) for _ in range(n)]


def by_histograms(data, roots):
    hist = child_histogram(data.binned, roots, data.block_size, data.n_features, data.root_hist, data.spec.n_bins + 1)
    return tf.child_tables(data, hist)


def as_set(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.mark.parametrize("kind,large", [("bigint", 10**9), ("bigint", 60), ("double", 10**9), ("string", 60)])
def test_whole_classes_give_the_histogram_tables(spark, monkeypatch, kind, large):
    monkeypatch.setattr(tf, "LARGE_CLASS", large)        # none or some classes go through cells
    monkeypatch.setattr(tf, "SUM_CELLS", 500)            # several passes
    monkeypatch.setattr(cs, "GATHER", 200)               # several gatherings and counts in a task
    monkeypatch.setattr(cs, "COUNT_CELLS", 400)
    data = tf.prepare(table(spark, labels_of(kind), kind), 3, 8)
    assert (data.large_hist is None) == (large > 10**6)
    thresholds = next_train_bins(data.root_hist)
    assert as_set(data.thresholds, "f", "b", "t") == as_set(thresholds, "f", "b", "t")
    assert as_set(data.root_best, "f", "t", "score") == as_set(best_splits(data.root_hist, thresholds), "f", "t", "score")
    node = data.root_hist.where("f = 0").groupBy("node", "y").agg({"n_train": "sum", "n_test": "sum"}) \
        .withColumnsRenamed({"sum(n_train)": "n_train", "sum(n_test)": "n_test"})
    assert data.root_correct == majority(node, ["node"]).first()["correct"]
    assert data.n_test == node.agg({"n_test": "sum"}).first()[0]
    roots = tf.needed_roots(tf.root_choices(data, tf.genes(init_population(spark, 12, N, 5), 3)))
    assert roots.count() > 1
    got, want = tf.child_statistics(data, roots), by_histograms(data, roots)
    assert as_set(got[0], "node", "f", "t", "score", "correct") == as_set(want[0], "node", "f", "t", "score", "correct")
    assert as_set(got[1], "node", "correct") == as_set(want[1], "node", "correct")


def test_no_table_of_all_cells(spark):
    """What prepare writes beside the rows doesn't grow with the number of classes."""
    workdir = tempfile.mkdtemp(prefix="classes-")
    data = tf.prepare(table(spark, [i // 3 for i in range(6000)], "bigint"), 3, 8, workdir=workdir)
    tasks = 8
    for name in set(os.listdir(workdir)) - {"binned"}:
        assert spark.read.parquet(f"{workdir}/{name}").count() <= tasks * N * 9 * 3, name
    assert data.binned.count() == 6000


@pytest.mark.parametrize("test_share", [1.0, 0.0])
def test_one_side_of_the_holdout_only(spark, test_share):
    """Without training rows the lowest label leads; without test rows there is no fitness."""
    data = tf.prepare(table(spark, labels_of("bigint", 300), "bigint", test_share=test_share), 3, 8)
    rows = [r for r in data.binned.collect() if r["bins"]]
    assert data.n_test == len(rows) * test_share
    nulls = sum(r["y"] is None for r in rows)
    assert data.root_correct == (nulls if test_share else 0)
    fitness = {r["fitness"] for r in tf.score_population(data, init_population(spark, 4, N, 5)).collect()}
    assert (fitness == {None}) == (not test_share)


def test_no_rows(spark):
    data = tf.prepare(table(spark, [], "bigint"), 3, 8)
    assert (data.n_test, data.root_correct) == (0, 0)
    assert {r["fitness"] for r in tf.score_population(data, init_population(spark, 3, N, 5)).collect()} == {None}
