import pytest
from pyspark.sql import functions as F

from sf_dirs import SF_SMALL
from evoselect.plans.generation import EvolveParams
from evoselect.plans.search import SearchParams, run_search
from evoselect.operators.ml_fitness import model_family
from evoselect.sources.datasets import embeddings_table, lineitem_table
from evoselect.sources.population import read_table


def test_search_loop_runs_and_keeps_the_best(spark):
    table = embeddings_table(spark, SF_SMALL, 42)
    params = SearchParams(population_size=20, block_size=16, max_generations=3, plateau_k=4,
                          evolve=EvolveParams(n_parts=2, seed=5, mutation_rate=0.02, elitism=1))
    res = run_search(table, params)
    hist = res.history.collect()
    assert [r["generation"] for r in hist] == list(range(1, res.generations + 1))
    best = [r["best_fitness"] for r in hist]
    assert best == sorted(best)                      # elitism: never drops
    for g in range(1, res.generations + 1):
        pop = read_table(spark, f"{res.workdir}/population").where(F.col("generation") == g)
        assert pop.count() == 20
        assert pop.where(F.col("fitness").isNull()).count() == 0


def test_search_stops_on_plateau(spark):
    table = embeddings_table(spark, SF_SMALL, 42)
    # no mutation, one part: offspring of a plateaued elite settle quickly; k = 2
    params = SearchParams(population_size=10, block_size=16, max_generations=8, plateau_k=2,
                          evolve=EvolveParams(n_parts=1, seed=1, mutation_rate=0.0, elitism=1))
    res = run_search(table, params)
    hist = [r["best_fitness"] for r in res.history.collect()]
    assert res.stopped_on_plateau and res.generations == len(hist)
    assert hist[-1] == hist[-2]
    assert all(hist[i] != hist[i + 1] for i in range(len(hist) - 2))


def _rows(df):
    return [tuple(r) for r in df.select("generation", "best_id", "best_genome", "best_fitness", "n_scored").collect()]


def test_a_stopped_run_goes_on_to_the_same_history(spark):
    from evoselect.session import scratch_path
    table = embeddings_table(spark, SF_SMALL, 42)

    def params(most, seed=5):
        return SearchParams(population_size=12, block_size=16, max_generations=most, plateau_k=9,
                            evolve=EvolveParams(n_parts=2, seed=seed, mutation_rate=0.02, elitism=1))
    whole = run_search(table, params(4))
    d = scratch_path(spark, "stopped")
    run_search(table, params(2), d)
    read_table(spark, f"{d}/history", 2).write.parquet(f"{d}/elites/data/generation=3/attempt=lost")  # half a generation
    again = run_search(table, params(4), d)
    assert _rows(again.history) == _rows(whole.history) and again.generations == 4
    third = run_search(table, params(4), d)
    assert _rows(third.history) == _rows(whole.history)
    with pytest.raises(ValueError, match="other data or parameters"):
        run_search(table, params(4, seed=6), d)


def test_population_never_shrinks(spark):
    table = lineitem_table(spark, SF_SMALL, 42)
    params = SearchParams(population_size=40, block_size=3, max_generations=3, plateau_k=9,
                          evolve=EvolveParams(n_parts=4, seed=2, mutation_rate=0.0, elitism=1))
    res = run_search(table, params)
    sizes = [read_table(spark, f"{res.workdir}/population", g).count() for g in (1, 2, 3)]
    assert sizes == [40, 40, 40]
    lost = read_table(spark, f"{res.workdir}/population", 1).where("fitness IS NULL").count()
    assert lost > 0        # some could not be scored; others took their places


def test_unknown_models_are_refused(spark):
    with pytest.raises(ValueError, match="unknown model"):
        run_search(embeddings_table(spark, SF_SMALL, 42), SearchParams(model="banana"))
    assert [model_family(m) for m in ("tree", "decision", "d", "logistic")] == ["tree"] * 3 + ["logistic"]


def test_search_with_logistic_model_and_elites(spark):
    table = embeddings_table(spark, SF_SMALL, 42)
    params = SearchParams(population_size=6, block_size=32, max_generations=2, plateau_k=4, model="logistic",
                          evolve=EvolveParams(n_parts=1, seed=3, mutation_rate=0.0, elitism=1))
    res = run_search(table, params)
    hist = res.history.collect()
    assert len(hist) == 2 and hist[1]["best_fitness"] >= hist[0]["best_fitness"]
    elites = read_table(spark, f"{res.workdir}/elites").collect()
    assert sorted({r["generation"] for r in elites}) == [1, 2]
    for h in hist:     # the global best is the best of the per-part elites
        mine = [e["fitness"] for e in elites if e["generation"] == h["generation"]]
        assert max(mine) == h["best_fitness"]


def test_fitness_memo_does_not_change_results(spark):
    table = embeddings_table(spark, SF_SMALL, 42)
    runs = []
    for memo in (True, False):
        params = SearchParams(population_size=12, block_size=16, max_generations=3, plateau_k=9,
                              fitness_memo=memo,
                              evolve=EvolveParams(n_parts=2, seed=7, mutation_rate=0.0, elitism=1))
        res = run_search(table, params)
        pops = []
        for g in range(1, res.generations + 1):
            pop = read_table(spark, f"{res.workdir}/population").where(F.col("generation") == g)
            pops.append(sorted((r["individual_id"], tuple(r["genome"]), r["fitness"]) for r in pop.collect()))
        runs.append((pops, [tuple(r) for r in res.history.select("generation", "best_id", "best_fitness").collect()]))
    assert runs[0] == runs[1]


def test_readers_see_whole_generations_only(spark):
    """A reader loops while a generation is replaced, and while writes fail."""
    import threading
    from evoselect.session import scratch_path
    from evoselect.sources.population import committed, write_part
    path = scratch_path(spark, "table")
    with pytest.raises(FileNotFoundError):
        read_table(spark, path)
    rows = spark.range(2000).repartition(8)
    write_part(rows.withColumn("mark", F.lit(0)), path, 1)
    write_part(rows.limit(5).withColumn("mark", F.lit(0)), path, 2)
    seen, done, wrong = set(), threading.Event(), []

    def reader():
        while not done.is_set():
            try:
                got = [(r["mark"], r["count"]) for r in read_table(spark, path, 1).groupBy("mark").count().collect()]
            except Exception as e:        # a missing or half-written folder
                wrong.append(e)
                return
            seen.update(m for m, _ in got)
            if [n for _, n in got] != [2000]:
                wrong.append(got)
    thread = threading.Thread(target=reader)
    thread.start()
    for k in range(1, 7):
        write_part(rows.withColumn("mark", F.lit(k)), path, 1)
        with pytest.raises(Exception):
            write_part(rows.withColumn("mark", F.raise_error(F.lit("stopped")).cast("int")), path, 1)
    done.set()
    thread.join()
    assert not wrong and seen and seen <= set(range(7))
    assert read_table(spark, path, 1).select("mark").distinct().collect() == [(6,)]
    assert sorted(committed(spark, path)) == [1, 2]
    assert read_table(spark, path).groupBy("generation").count().orderBy("generation").collect() == [(1, 2000), (2, 5)]
