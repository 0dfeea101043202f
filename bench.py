"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line: {"metric", "value", "unit", "queries": {...}, "sf"}.
``value`` is the sum of the per-query wall times (each query is fully
materialised with a no-op write).  ``sec_per_individual`` compares the
batched tree (24 individuals in one plan) with the reference's structure
(one MLlib fit per individual and block, serially) on the same data.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from evoselect.plans import queries as Q  # noqa: E402
from evoselect.session import clear_scratch, local_session, scratch_path  # noqa: E402


def _run(spark, fn, sf_dir):
    t0 = time.time()
    fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.time() - t0


def _search(spark, sf_dir):
    from evoselect.plans.generation import EvolveParams
    from evoselect.plans.search import SearchParams, run_search
    from evoselect.sources.datasets import embeddings_table
    t0 = time.time()
    res = run_search(embeddings_table(spark, sf_dir, 42),
                     SearchParams(population_size=40, block_size=16, max_generations=5, plateau_k=4,
                                  evolve=EvolveParams(n_parts=4, mutation_rate=0.01)),
                     workdir=scratch_path(spark, "bench_search"))
    return time.time() - t0, res.generations


def _per_individual(spark, sf_dir):
    """Seconds per individual: batched tree (24 at once) vs the reference's
    structure (one MLlib fit per individual and block, run serially)."""
    from evoselect.operators import tree_fitness as tf
    from evoselect.operators.ml_fitness import prepare_ml, score_population_ml
    from evoselect.operators.population import init_population
    from evoselect.sources.datasets import embeddings_table
    t = embeddings_table(spark, sf_dir, 42)
    t0 = time.time()          # both sides pay for their own preparation
    data = tf.prepare(t, 16, 32)
    tf.score_population(data, init_population(spark, 24, t.n_features, 42)).collect()
    batched = (time.time() - t0) / 24
    t0 = time.time()
    ml = prepare_ml(t, data.binned)
    score_population_ml(ml, init_population(spark, 2, t.n_features, 42), 16, "tree", parallelism=1).collect()
    serial = (time.time() - t0) / 2
    return {"batched_tree": round(batched, 3), "serial_mllib_tree": round(serial, 3)}


def _duplicated(spark, sf_dir, times):
    """Seconds of the lineitem tree fitness on ``times`` copies of the rows,
    and microseconds a row."""
    from evoselect.operators import tree_fitness as tf
    from evoselect.operators.population import init_population
    from evoselect.sources.datasets import LabeledTable, lineitem_table
    t = lineitem_table(spark, sf_dir, 42)
    many = LabeledTable(t.df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(times)))).drop("copy"), t.feature_names)
    rows = many.df.count()
    t0 = time.time()
    tf.score_population(tf.prepare(many, 3, 32), init_population(spark, 16, t.n_features, 42)).collect()
    secs = time.time() - t0
    return secs, 1e6 * secs / rows


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8, app_name="evoselect-bench")
    # warm-up: JVM, parquet footers, codegen caches
    _run(spark, Q.q_class_count, sf_dir)
    times = {}
    for name in ("root_histogram", "root_splits", "tree_fitness_embeddings", "tree_fitness_lineitem",
                 "tree_fitness_documents", "csv_label_attach", "tree_fitness_many_classes", "next_generation", "generation_plateau", "tree_fitness_mllib"):
        times[name] = round(_run(spark, Q.QUERIES[name], sf_dir), 3)
    secs, gens = _search(spark, sf_dir)
    times["search_5_generations"] = round(secs, 3)
    per_ind = _per_individual(spark, sf_dir)
    micros = {}
    for k in (1, 10):
        s, micros[f"lineitem_x{k}"] = (round(x, 3) for x in _duplicated(spark, sf_dir, k))
        times[f"tree_fitness_lineitem_x{k}"] = s
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {
        "metric": "evoselect_headline_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
        "search_generations": gens,
        "sec_per_individual": per_ind,
        "microseconds_per_row": micros,
        "cpus": cpus,
    }
    clear_scratch(spark)
    print(json.dumps(out))


if __name__ == "__main__":
    main()
