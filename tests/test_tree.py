"""Batched depth-2 gini trees: vs pyspark.ml and vs a plain-Python tree."""
import os
import tempfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sf_dirs import SF_SMALL
from evoselect.operators import tree_fitness as tf
from evoselect.operators.binning import fit_quantile_bins
from evoselect.operators.population import init_population
from evoselect.sources.csv import attach_labels, csv_table, read_feature_csv, read_labels, write_csv_pair
from evoselect.sources.datasets import LabeledTable, documents_table, embeddings_table, lineitem_table


def _py_tree_correct(train, test, feats, thresholds_of):
    """Depth-2 gini tree on binned rows, MLlib split rules, plain Python."""
    def score(rows, f, t):
        left = [r for r in rows if r[0][f] <= t]
        right = [r for r in rows if r[0][f] > t]
        if not left or not right:
            return None
        sl = sum(c * c for c in Counter(r[1] for r in left).values())
        sr = sum(c * c for c in Counter(r[1] for r in right).values())
        return sl / len(left) + sr / len(right)

    def best(rows):
        n = len(rows)
        parent = sum(c * c for c in Counter(r[1] for r in rows).values()) / n
        top = None
        for f in feats:
            for t in thresholds_of[f]:
                s = score(rows, f, t)
                if s is not None and s - parent > 1e-12 * parent and (top is None or s > top[0]):
                    top = (s, f, t)
        return top

    def majority(rows):
        c = Counter(r[1] for r in rows)
        return min(c, key=lambda y: (-c[y], y))

    def leaf_correct(tr_rows, te_rows):
        m = majority(tr_rows)
        return sum(1 for r in te_rows if r[1] == m)

    root = best(train)
    if root is None:
        return leaf_correct(train, test)
    _, f, t = root
    total = 0
    for side in (0, 1):
        tr = [r for r in train if (r[0][f] <= t) == (side == 0)]
        te = [r for r in test if (r[0][f] <= t) == (side == 0)]
        child = best(tr)
        if child is None:
            total += leaf_correct(tr, te)
        else:
            _, f2, t2 = child
            for s2 in (0, 1):
                tr2 = [r for r in tr if (r[0][f2] <= t2) == (s2 == 0)]
                te2 = [r for r in te if (r[0][f2] <= t2) == (s2 == 0)]
                total += leaf_correct(tr2, te2)
    return total


@pytest.mark.parametrize("builder,block", [(embeddings_table, 16), (lineitem_table, 3), (documents_table, 4)])
def test_batch_tree_matches_python_tree(spark, builder, block):
    table = builder(spark, SF_SMALL, 42)
    data = tf.prepare(table, block, 32)
    rows = data.binned.collect()
    train = [(r["bins"], r["y"]) for r in rows if not r["is_test"]]
    test = [(r["bins"], r["y"]) for r in rows if r["is_test"]]
    seen = {}
    for f in range(table.n_features):
        vals = sorted({r[0][f] for r in train})
        seen[f] = [(a + b) // 2 for a, b in zip(vals, vals[1:])]
    pop = init_population(spark, 6, table.n_features, 7)
    got = {r["individual_id"]: r for r in tf.score_population(data, pop).collect()}
    for ind in pop.collect():
        g = ind["genome"]
        total, empty = 0, False
        for b in range(data.n_blocks):
            feats = [f for f in range(b * block, min((b + 1) * block, table.n_features)) if g[f] == 1]
            if not feats:
                empty = True
                continue
            total += _py_tree_correct(train, test, feats, seen)
        r = got[ind["individual_id"]]
        if empty:
            assert r["fitness"] is None
        else:
            assert r["correct"] == total
            assert abs(r["fitness"] - total / (data.n_blocks * len(test))) < 1e-6


def test_batch_tree_matches_mllib(spark):
    from evoselect.operators.ml_fitness import prepare_ml, score_population_ml
    table = embeddings_table(spark, SF_SMALL, 42)
    data = tf.prepare(table, 16, 32)
    pop = init_population(spark, 3, table.n_features, 42)
    ml = score_population_ml(prepare_ml(table, data.binned), pop, 16, "tree")
    batch = {r["individual_id"]: r["correct"] for r in tf.score_population(data, pop).collect()}
    assert {r["individual_id"]: r["correct"] for r in ml.collect()} == batch


def test_logistic_fitness_bounds(spark):
    from evoselect.operators.ml_fitness import prepare_ml, score_population_ml
    table = embeddings_table(spark, SF_SMALL, 42)
    pop = init_population(spark, 2, table.n_features, 42)
    rows = score_population_ml(prepare_ml(table), pop, 32, "logistic").collect()
    assert len(rows) == 2
    assert all(0.0 <= r["fitness"] <= 1.0 for r in rows)


def test_csv_roundtrip_aligns_labels(spark):
    table = embeddings_table(spark, SF_SMALL, 42)
    d = tempfile.mkdtemp(prefix="csvfix-")
    write_csv_pair(table, os.path.join(d, "train_data"), os.path.join(d, "train_labels"), test=False)
    write_csv_pair(table, os.path.join(d, "test_data"), os.path.join(d, "test_labels"), test=True)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")      # force many splits per file
    try:
        feats = read_feature_csv(spark, os.path.join(d, "train_data"))
        labs = read_labels(spark, os.path.join(d, "train_labels"))
        idx = sorted(r["row_idx"] for r in feats.collect())
        assert idx == list(range(len(idx))) and labs.count() == len(idx)
        train = table.df.where("NOT is_test").orderBy("row_key").collect()
        got = attach_labels(feats, labs).orderBy("row_idx").collect()
        assert [float(r["label"]) for r in train] == [r["label"] for r in got]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    back = csv_table(spark, os.path.join(d, "train_data"), os.path.join(d, "train_labels"),
                     os.path.join(d, "test_data"), os.path.join(d, "test_labels"))
    assert back.n_features == table.n_features
    # same (label, first feature) multiset on each side; floats survive text
    orig = sorted((r["is_test"], float(r["label"]), round(r["features"][0], 6)) for r in table.df.collect())
    new = sorted((r["is_test"], r["label"], round(r["features"][0], 6)) for r in back.df.collect())
    assert orig == new


def test_empty_block_gives_null_fitness(spark):
    table = embeddings_table(spark, SF_SMALL, 42)
    data = tf.prepare(table, 16, 32)
    g = [1] * 16 + [0] * 16 + [1] * 32
    pop = spark.createDataFrame([(1, 0, g, None), (1, 1, [0] * 64, None)],
                                "generation int, individual_id bigint, genome array<int>, fitness double")
    res = {r["individual_id"]: r for r in tf.score_population(data, pop).collect()}
    assert res[0]["fitness"] is None and res[0]["n_blocks_used"] == 3
    assert res[1]["fitness"] is None and res[1]["n_blocks_used"] == 0


def test_odd_values_keep_other_bins(spark):
    from evoselect.operators.binning import bin_features, fit_bins
    from evoselect.sources.datasets import LabeledTable
    nan, inf = float("nan"), float("inf")
    rows = [(str(k), k % 2, k % 5 == 0, [float(k)]) for k in range(1, 101)]
    plain = LabeledTable(spark.createDataFrame(rows, "row_key string, label int, is_test boolean, features array<double>"), ("x",))
    odd = spark.createDataFrame([("n", 0, False, [nan]), ("i", 0, False, [inf]), ("m", 0, False, [-inf]), ("z", 0, False, [None])],
                                plain.df.schema)
    mixed = LabeledTable(plain.df.union(odd), ("x",))
    assert fit_bins(mixed, 32) == fit_bins(plain, 32)
    got = {r[0]: r[1][0] for r in mixed.df.select("row_key", bin_features(F.col("features"), fit_bins(mixed, 32))).collect()}
    assert (got["n"], got["i"], got["m"], got["z"]) == (32, 31, 0, 32) and len(set(got.values())) == 33


def _folder(spark, path, files):
    """One text file per list, in name order whatever the sizes."""
    os.makedirs(path)
    for k, lines in enumerate(files):
        with open(f"{path}/part-{k:05d}.txt", "w") as f:
            f.writelines(f"{x}\n" for x in lines)


def test_csv_folders_of_uneven_files(spark):
    d = tempfile.mkdtemp(prefix="csvfix-")
    ids = list(range(360))
    _folder(spark, f"{d}/data", [[f"{k},{k}.5" for k in part] for part in (ids[:10], ids[10:310], ids[310:])])
    _folder(spark, f"{d}/labels", [ids])
    _folder(spark, f"{d}/short", [ids[:200]])
    got = attach_labels(read_feature_csv(spark, f"{d}/data"), read_labels(spark, f"{d}/labels")).collect()
    assert len(got) == 360 and all(r["label"] == r["features"][0] == r["row_idx"] for r in got)
    with pytest.raises(Exception, match="number of lines"):
        attach_labels(read_feature_csv(spark, f"{d}/data"), read_labels(spark, f"{d}/short")).collect()


def test_scratch_is_refused_without_a_shared_folder():
    from types import SimpleNamespace as N
    from evoselect.session import checkpoint_root
    conf = N(get=lambda *a: None)
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            checkpoint_root(N(sparkContext=N(getConf=lambda: conf, master=master), conf=conf))


def test_many_classes_and_a_hot_one(spark):
    """200 classes, a third of the rows in one."""
    table = lineitem_table(spark, SF_SMALL, 42, "l_partkey")
    hot = table.df.withColumn("label", F.when(F.crc32(F.encode("row_key", "UTF-8")) % 3 == 0, F.lit(1)).otherwise(F.col("label")))
    table = type(table)(hot, table.feature_names)
    data = tf.prepare(table, 3, 32)
    rows = data.binned.collect()
    train = [(r["bins"], r["y"]) for r in rows if not r["is_test"]]
    test = [(r["bins"], r["y"]) for r in rows if r["is_test"]]
    seen = {f: [(a + b) // 2 for a, b in zip(v, v[1:])] for f, v in
            ((f, sorted({r[0][f] for r in train})) for f in range(table.n_features))}
    pop = spark.createDataFrame([(1, 0, [1, 0, 1, 0, 1, 1], None)], "generation int, individual_id bigint, genome array<int>, fitness double")
    (got,) = tf.score_population(data, pop).collect()
    assert got["correct"] == _py_tree_correct(train, test, [0, 2], seen) + _py_tree_correct(train, test, [4, 5], seen)


def test_scratch_can_be_cleared(spark):
    from evoselect.session import checkpoint_root, materialize
    own = materialize(spark.range(3), "x").inputFiles()[0]
    assert spark.sparkContext.applicationId in own and checkpoint_root(spark) in own


def test_quantile_borders_are_exact_ranks(spark):
    n = 200_003
    df = spark.range(n, numPartitions=7).select(
        F.col("id").cast("string").alias("row_key"), F.lit("a").alias("label"), (F.col("id") % 9 == 0).alias("is_test"),
        F.array(F.pmod(F.xxhash64("id"), F.lit(10_000_019)).cast("double"), F.sqrt(F.pmod(F.hash("id"), F.lit(90_000))),
                F.when(F.col("id") % 3 > 0, 4.0).when(F.col("id") % 5 > 0, F.col("id") / 7).otherwise(float("nan")),
                F.when(F.col("id") < 20, F.col("id").cast("double")), F.lit(None).cast("double")).alias("features"))
    table = LabeledTable(df, ("a", "b", "c", "d", "e"))
    want = []
    for column in zip(*[r["features"] for r in df.where("not is_test").collect()]):
        x = sorted(v for v in column if v is not None and v == v)
        want.append(tuple(x[-(-i * len(x) // 32) - 1] for i in range(1, 32)) if x else ())
    assert fit_quantile_bins(table).cuts == tuple(want)
    assert fit_quantile_bins(table, range_values=3_000).cuts == tuple(want)


def test_csv_files_grow_in_number_with_the_rows(spark, tmp_path):
    df = spark.range(2_000).select(F.lpad(F.col("id").cast("string"), 5, "0").alias("row_key"),
                                   F.col("id").alias("label"), F.lit(False).alias("is_test"),
                                   F.array(F.col("id").cast("double")).alias("features"))
    d, lab = str(tmp_path / "data"), str(tmp_path / "labels")
    write_csv_pair(LabeledTable(df, ("a",)), d, lab, test=False, rows_per_file=100)
    files = [sum(f.endswith(".txt") for f in os.listdir(x)) for x in (d, lab)]
    assert files[0] >= 20 and files[1] >= 20 and files[0] != files[1]
    rows = attach_labels(read_feature_csv(spark, d), read_labels(spark, lab)).collect()
    assert len(rows) == 2_000 and all(float(r["label"]) == r["features"][0] for r in rows)
