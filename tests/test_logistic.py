import random

import numpy as np
import pytest
from evoselect.operators import logistic as lg
from evoselect.operators.ml_fitness import prepare_ml, score_population_ml
from evoselect.operators.population import init_population
from evoselect.plans.search import SearchParams, run_search
from evoselect.plans.generation import EvolveParams
from evoselect.sources.datasets import LabeledTable, embeddings_table
from pyspark.sql import functions as F
from sf_dirs import SF_SMALL


def table(spark, rows, width):
    df = spark.createDataFrame(rows, "row_key string, label string, is_test boolean, features array<double>")
    return LabeledTable(df, tuple(f"f{k}" for k in range(width)))


def noisy(rng, n, width=6, classes="abc"):
    rows = []
    for k in range(n):
        y = rng.randrange(len(classes))
        rows.append((str(k), classes[y], k % 5 == 0, [rng.gauss(0.5 * y if f == y else 0, 1 + f) for f in range(width)]))
    return rows


def all_models(data, genomes):
    return sorted({m for ms in lg.distinct_models(genomes, data).values() for m in ms if m.chosen},
                  key=lambda m: (m.block, m.chosen))


def test_coefficients_equal_pyspark_ml(spark):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector
    t = table(spark, noisy(random.Random(0), 400), 6)
    data = lg.prepare_logistic(t, 3)
    models = all_models(data, {0: [1, 1, 0, 1, 1, 1], 1: [0, 1, 1, 0, 0, 1]})
    found = lg.fit(data, models)
    assert found.converged.all()
    mine = {(m, f, c): v for m, f, c, v in lg.coefficients(data, found)}
    for m, model in enumerate(models):
        columns = [model.block * 3 + f for f in model.chosen]
        train = t.df.where("NOT is_test").select(
            (F.ascii("label") - 97).cast("double").alias("label"),
            array_to_vector(F.array(*[F.col("features")[c] for c in columns])).alias("x"))
        theirs = LogisticRegression(featuresCol="x", family="multinomial", fitIntercept=False, maxIter=500, tol=1e-13) \
            .fit(train)
        want = theirs.coefficientMatrix.toArray()
        got = np.array([[mine[m, f, c] for f in columns] for c in range(3)])
        assert abs(got - want).max() < 1e-6
        assert theirs.summary.objectiveHistory[-1] == pytest.approx(found.loss[m], abs=1e-9)


def test_scores_equal_one_fit_per_model(spark):
    t = embeddings_table(spark, SF_SMALL, 42)
    pop = init_population(spark, 3, t.n_features, 42)
    got = {r["individual_id"]: r for r in lg.score_population_logistic(lg.prepare_logistic(t, 16), pop).collect()}
    for r in score_population_ml(prepare_ml(t), pop, 16, "logistic").collect():
        assert abs(got[r["individual_id"]]["correct"] - r["correct"]) <= 1      # pyspark.ml stops at 1e-6


def test_passes_are_those_of_the_slowest_model(spark, monkeypatch):
    t = table(spark, noisy(random.Random(1), 200), 6)
    data = lg.prepare_logistic(t, 3)
    rng = random.Random(2)
    genomes = {k: [rng.randrange(2) for _ in range(6)] for k in range(40)}
    models = all_models(data, genomes)
    together = lg.fit(data, models)
    alone = [lg.fit(data, [m]) for m in models[:4]]
    assert together.passes < 40 and all(a.passes <= together.passes for a in alone)
    for m, a in enumerate(alone):
        assert abs(a.coefficients[0] - together.coefficients[m]).max() < 1e-9


@pytest.mark.parametrize("limit", ["STATE_BYTES", "PARTIAL_BYTES"])
def test_bounds_change_no_result(spark, monkeypatch, limit):
    t = table(spark, noisy(random.Random(3), 150), 6)
    t = LabeledTable(t.df.repartition(7), t.feature_names)
    pop = init_population(spark, 2, 6, 1)
    data = lg.prepare_logistic(t, 3)
    data.train, data.tasks = data.train.repartition(34), 34
    want = lg.score_population_logistic(data, pop).collect()
    monkeypatch.setattr(lg, limit, 1 if limit == "STATE_BYTES" else 3000)
    monkeypatch.setattr(lg, "PIECE_BYTES", 64)
    models = all_models(data, {0: [1] * 6, 1: [1, 0, 1, 1, 0, 0]})
    assert (len(list(lg.waves(models, data))) > 1) == (limit == "STATE_BYTES")
    got = lg.score_population_logistic(data, pop).collect()
    assert [(r["individual_id"], r["correct"], r["fitness"]) for r in got] == \
        [(r["individual_id"], r["correct"], r["fitness"]) for r in want]


def test_odd_rows(spark):
    rng = random.Random(4)
    rows = noisy(rng, 120, 4)
    rows += [("n1", "a", False, [None, float("nan"), float("inf"), 1.0]), ("n2", None, False, [1.0] * 4),
             ("n3", "zz", True, [1.0] * 4)]                    # a class that only a test row has
    rows = [(k, y, test, [*x[:3], 5.0]) for k, y, test, x in rows]       # a constant feature
    data = lg.prepare_logistic(table(spark, rows, 4), 2)
    assert data.classes == ["a", "b", "c"]
    pop = spark.createDataFrame([(0, [1, 1, 1, 1]), (1, [1, 0, 0, 0]), (2, [0, 0, 0, 1])], "individual_id long, genome array<int>")
    got = {r["individual_id"]: r for r in lg.score_population_logistic(data, pop).collect()}
    assert got[0]["fitness"] is not None and got[1]["fitness"] is None and got[2]["fitness"] is None
    own = lg.distinct_models({0: [1, 1, 1, 1]}, data)
    said = lg.individual_predictions(data, own).collect()
    assert sum(r["label"] == r["class"] for r in said) == got[0]["correct"]
    assert {r["class"] for r in said} <= {"a", "b", "c"}
    constant = lg.fit(data, [lg.Model(1, (1,))])
    assert not constant.coefficients.any() and constant.converged.all()


def test_no_rows(spark):
    pop = init_population(spark, 2, 2, 1)
    for rows in ([], [("1", "a", False, [1.0, 2.0])], [("1", "a", True, [1.0, 2.0])]):
        got = lg.score_population_logistic(lg.prepare_logistic(table(spark, rows, 2), 2), pop).collect()
        assert [r["fitness"] for r in got] == [None, None]


def test_separable_classes_end(spark):
    rows = [(str(k), "ab"[k % 2], k % 7 == 0, [float(k % 2) - 0.5, 1.0 + k % 3]) for k in range(80)]
    data = lg.prepare_logistic(table(spark, rows, 2), 2)
    found = lg.fit(data, [lg.Model(0, (0, 1))])
    assert found.passes < lg.MAX_PASSES and found.loss[0] < 1e-6
    assert lg.correct_counts(data, found)[0] == data.n_test


def test_search_with_logistic_models(spark):
    t = table(spark, noisy(random.Random(5), 150), 6)
    res = run_search(t, SearchParams(population_size=8, block_size=3, max_generations=2, model="logistic",
                                     evolve=EvolveParams(n_parts=2, mutation_rate=0.1)))
    assert res.history.count() == 2
