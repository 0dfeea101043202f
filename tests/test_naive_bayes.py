import math
import random

from evoselect.operators.ml_fitness import model_family
from evoselect.operators.naive_bayes import SMOOTHING, prepare_naive_bayes, score_population_naive_bayes
from evoselect.plans.generation import EvolveParams
from evoselect.plans.search import SearchParams, run_search
from evoselect.sources.datasets import LabeledTable

GENOMES = [(0, [1, 1, 1, 1, 1]), (1, [1, 0, 0, 1, 0]), (2, [0, 0, 0, 1, 1]), (3, [0, 1, 1, 0, 1]), (4, [1, 0, 0, 1, 0])]


def rows_of(rng, n):
    out = []
    for k in range(n):
        y = rng.randrange(3)
        x = [rng.gauss(y * (f % 2), 1) for f in range(5)]
        if k % 11 == 0:
            x[k % 5] = rng.choice([None, float("nan"), float("inf")])
        out.append((str(k), "abc"[y], k % 4 == 0, x))
    return out + [("n1", None, False, [9.0] * 5), ("n2", "zz", True, [1.0] * 5)]


def table(spark, rows):
    df = spark.createDataFrame(rows, "row_key string, label string, is_test boolean, features array<double>")
    return LabeledTable(df, tuple(f"f{k}" for k in range(5)))


def ok(v):
    return v is not None and math.isfinite(v)


def plain(rows, genome, size):
    train = [r for r in rows if not r[2] and r[1]]
    test = [r for r in rows if r[2] and r[1]]
    classes = sorted({r[1] for r in train})
    correct = 0
    for b in range(0, 5, size):
        chosen = [f for f in range(b, min(5, b + size)) if genome[f]]
        if not chosen:
            return None
        for _, y, _, x in test:
            best = None
            for c in classes:
                own = [r[3] for r in train if r[1] == c]
                z = math.log(len(own) / len(train))
                for f in chosen:
                    if ok(x[f]):
                        v = [o[f] for o in own if ok(o[f])]
                        m = sum(v) / len(v)
                        var = sum((a - m) ** 2 for a in v) / len(v) + SMOOTHING
                        z += -0.5 * (math.log(2 * math.pi * var) + (x[f] - m) ** 2 / var)
                if best is None or z > best[0]:
                    best = (z, c)
            correct += best[1] == y
    return correct


def test_equals_plain_version(spark):
    rows = rows_of(random.Random(0), 160)
    pop = spark.createDataFrame(GENOMES, "individual_id long, genome array<int>")
    data = prepare_naive_bayes(table(spark, rows), 3)
    got = {r["individual_id"]: r for r in score_population_naive_bayes(data, pop).collect()}
    n = sum(r[2] for r in rows)
    for ind, g in GENOMES:
        want = plain(rows, g, 3)
        assert got[ind]["fitness"] == (None if want is None else want / (2 * n))
        assert want is None or got[ind]["correct"] == want


def test_no_rows(spark):
    pop = spark.createDataFrame(GENOMES, "individual_id long, genome array<int>")
    for rows in ([], [("1", "a", False, [1.0] * 5)], [("1", "a", True, [1.0] * 5)]):
        got = score_population_naive_bayes(prepare_naive_bayes(table(spark, rows), 3), pop).collect()
        assert [r["fitness"] for r in got] == [None] * 5


def test_search_runs_any_model(spark):
    assert model_family("naive") == "bayes"
    t = table(spark, rows_of(random.Random(1), 120))
    res = run_search(t, SearchParams(population_size=8, block_size=3, max_generations=2, model="naive",
                                     evolve=EvolveParams(n_parts=2, mutation_rate=0.1)))
    assert res.history.count() == 2
