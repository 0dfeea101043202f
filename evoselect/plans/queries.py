"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame.

All of them read the given tables (their work grows with the data).  The
GA operators run on a population that is scored on ``embeddings`` first,
so every query includes a real fitness pass.  Genomes are returned as text
(``b0|b1|...|``) so results hash the same in any engine.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.genome import block_popcounts, genome_from_text, genome_text, has_selection, popcount
from ..operators import tree_fitness as tf
from ..operators.binning import bin_features, fit_bins
from ..operators.crossover import bit_mutation, uniform_crossover
from ..operators.elite import elite_global, elite_per_part, history_report, plateau
from ..operators.histogram import root_histogram
from ..operators.population import (
    init_population, legacy_fitness_line, nonempty, parse_fitness, unscored, with_fitness)
from ..operators.population import scored as scored_rows
from ..operators.selection import assign_parts, ranges_of, tournament_pairs, tournament_winners, with_ordinal
from ..operators.splits import best_splits, next_train_bins, split_candidates
from ..session import materialize, scratch_path
from ..sources.datasets import LabeledTable, documents_table, embeddings_table, lineitem_table, wide_table
from .generation import EvolveParams, next_generation


@dataclass(frozen=True)
class Setup:
    """Fixed parameters of the registered queries (shared with the oracles)."""
    seed: int = 42
    population: int = 24
    block_size: int = 16
    n_bins: int = 32
    n_parts: int = 4
    mutation_rate: float = 0.05


EMB = Setup()
LINEITEM = Setup(population=16, block_size=3)
DOCS = Setup(population=16, block_size=4)


def _scored(spark: SparkSession, table: LabeledTable, s: Setup) -> tuple[DataFrame, tf.TreeData]:
    data = tf.prepare(table, s.block_size, s.n_bins)
    pop = init_population(spark, s.population, table.n_features, s.seed)
    scores = tf.score_population(data, pop)
    return materialize(with_fitness(pop, scores.select("individual_id", "fitness")), "scored"), data


def _fitness_report(spark: SparkSession, table: LabeledTable, s: Setup, borders: str = "widths") -> DataFrame:
    data = tf.prepare(table, s.block_size, s.n_bins, borders=borders)
    pop = init_population(spark, s.population, table.n_features, s.seed)
    scores = tf.score_population(data, pop)
    return pop.drop("fitness").join(scores, "individual_id").select(
        "individual_id",
        genome_text(F.col("genome")).alias("genome_text"),
        popcount(F.col("genome")).alias("n_selected"),
        F.array_join(block_popcounts(F.col("genome"), table.n_features, s.block_size), ",")
        .alias("block_counts"),
        has_selection(F.col("genome")).alias("nonempty"),
        "correct", "n_blocks_used", "fitness")


# ---------------------------------------------------------------- data side
def q_feature_bins(spark, sf_dir):
    """P1/P2/DM12 + binning: long form of the binned embeddings."""
    t = embeddings_table(spark, sf_dir, EMB.seed)
    spec = fit_bins(t, EMB.n_bins)
    b = t.df.select("row_key", "is_test", bin_features(F.col("features"), spec).alias("bins"))
    return b.select("row_key", "is_test", F.posexplode("bins").alias("f", "bin")) \
        .withColumn("block", F.floor(F.col("f") / EMB.block_size).cast("int"))


def q_class_count(spark, sf_dir):
    """Classes and rows on each side of the hold-out split."""
    t = embeddings_table(spark, sf_dir, EMB.seed)
    return t.df.agg(F.count_distinct("label").alias("n_classes"),
                    F.count(F.lit(1)).alias("n_rows"),
                    F.sum(F.when(~F.col("is_test"), 1).otherwise(0)).alias("n_train"),
                    F.sum(F.when(F.col("is_test"), 1).otherwise(0)).alias("n_test"))


def q_masked_projection(spark, sf_dir):
    """Rows of embeddings projected on one genome's selected features
    (the genome is individual 0 of the seeded population)."""
    t = embeddings_table(spark, sf_dir, EMB.seed)
    g = init_population(spark, 1, t.n_features, EMB.seed).first()["genome"]   # one genome
    mask = F.lit(list(g))
    kept = F.filter("features", lambda x, i: F.element_at(mask, i + 1) == 1)
    return t.df.select("row_key", F.size(kept).alias("n_kept"), F.posexplode(kept).alias("pos", "value"))


def q_root_histogram(spark, sf_dir):
    """ML1a: feature x bin x class counts."""
    t = embeddings_table(spark, sf_dir, EMB.seed)
    data = tf.prepare(t, EMB.block_size, EMB.n_bins)
    return data.root_hist.select("f", "b", "y", "n_train", "n_test")


def q_root_splits(spark, sf_dir):
    """ML1b: best gini threshold of every feature at the root."""
    t = embeddings_table(spark, sf_dir, EMB.seed)
    data = tf.prepare(t, EMB.block_size, EMB.n_bins)
    cand = split_candidates(data.root_hist, data.thresholds)
    best = best_splits(data.root_hist, data.thresholds)
    return best.join(cand.select("node", "f", "t", "n_left", "n_right"), ["node", "f", "t"]) \
        .select("f", "t", "n_left", "n_right", "score")


def q_tree_fitness_embeddings(spark, sf_dir):
    """Flagship (J3, ML1a-c, ML4, A2, A3): accuracy of random feature subsets."""
    return _fitness_report(spark, embeddings_table(spark, sf_dir, EMB.seed), EMB)


def q_tree_fitness_lineitem(spark, sf_dir):
    return _fitness_report(spark, lineitem_table(spark, sf_dir, LINEITEM.seed), LINEITEM)


def q_tree_fitness_documents(spark, sf_dir):
    return _fitness_report(spark, documents_table(spark, sf_dir, DOCS.seed), DOCS)


def q_tree_fitness_quantile(spark, sf_dir):
    """ML1 on raw features: 32 thresholds from each feature's quantiles."""
    return _fitness_report(spark, embeddings_table(spark, sf_dir, EMB.seed), EMB, "quantiles")


WIDE = Setup(block_size=200)


def q_tree_fitness_wide(spark, sf_dir):
    """ML1a-c at the reference's width: 760 features in blocks of 200, 200, 200 and 160."""
    return _fitness_report(spark, wide_table(spark, sf_dir, WIDE.seed), WIDE)


def q_tree_predictions(spark, sf_dir):
    """ML3: the fitted tree of every (individual, block), and the class it gives every test row."""
    from ..operators.trees import fitted_trees, tree_predictions
    t = embeddings_table(spark, sf_dir, EMB.seed)
    data = tf.prepare(t, EMB.block_size, EMB.n_bins)
    pop = init_population(spark, EMB.population, t.n_features, EMB.seed)
    return tree_predictions(t, data, fitted_trees(data, pop)).select("row_key", "individual_id", "block", "predicted")


def q_tree_fitness_raw(spark, sf_dir):
    """ML1 on raw features, with the thresholds that pyspark.ml's tree picks from them."""
    return _fitness_report(spark, embeddings_table(spark, sf_dir, EMB.seed), EMB, "strides")


MANY = Setup(population=16, block_size=3)


def q_tree_fitness_many_classes(spark, sf_dir):
    """ML1a-c with as many classes as parts (``l_partkey``)."""
    return _fitness_report(spark, lineitem_table(spark, sf_dir, MANY.seed, "l_partkey"), MANY)


def with_missing(table: LabeledTable) -> LabeledTable:
    """``table`` with NaN, infinities and NULLs at fixed places of its features."""
    key = F.col("row_key").cast("bigint")

    def one(x, i):
        k = key + i
        return F.when(k % 97 == 0, float("nan")).when(k % 89 == 0, float("inf")).when(k % 83 == 0, -float("inf")) \
            .when(k % 79 == 0, F.lit(None).cast("double")).otherwise(x)
    return LabeledTable(table.df.withColumn("features", F.transform("features", one)), table.feature_names)


def q_feature_bins_missing(spark, sf_dir):
    """Binning of embeddings with injected NaN, infinities and NULLs."""
    t = with_missing(embeddings_table(spark, sf_dir, EMB.seed))
    b = t.df.select("row_key", "is_test", bin_features(F.col("features"), fit_bins(t, EMB.n_bins)).alias("bins"))
    return b.select("row_key", "is_test", F.posexplode("bins").alias("f", "bin"))


def q_csv_label_attach(spark, sf_dir):
    """Embeddings written in the four-file CSV layout under
    the scratch folder, read back and labels attached by line position."""
    from ..sources.csv import csv_table, write_csv_pair
    t = embeddings_table(spark, sf_dir, EMB.seed)
    d = scratch_path(spark, "csv")
    write_csv_pair(t, f"{d}/train_data", f"{d}/train_labels", test=False)
    write_csv_pair(t, f"{d}/test_data", f"{d}/test_labels", test=True)
    back = csv_table(spark, f"{d}/train_data", f"{d}/train_labels", f"{d}/test_data",
                     f"{d}/test_labels", n_features=t.n_features)
    return back.df.select(
        "is_test", F.regexp_extract("row_key", r"(\d+)$", 1).cast("bigint").alias("row_idx"),
        "label", F.size("features").alias("n_values"),
        F.element_at("features", 1).alias("first_value"), F.element_at("features", -1).alias("last_value"))


def q_csv_rejects(spark, sf_dir):
    """Embeddings written as CSV with fields that are no numbers and
    lines that are too short; what the lenient reader rejects."""
    from ..sources.csv import read_feature_csv_lenient
    t = embeddings_table(spark, sf_dir, EMB.seed)
    key = F.col("row_key").cast("bigint")
    texts = F.transform("features", lambda x, i: F.when((key + i) % 97 == 0, "n/a").when((key + i) % 89 == 0, "")
                        .otherwise(x.cast("string")))
    kept = F.when(key % 50 == 7, F.slice(texts, 1, F.size(texts) - 1)).otherwise(texts)
    path = scratch_path(spark, "csv_bad")
    t.df.select(key.alias("key"), F.array_join(kept, ",").alias("value")).repartitionByRange(3, "key") \
        .sortWithinPartitions("key").select("value").write.text(path)
    return read_feature_csv_lenient(spark, path, t.n_features)[1].select("row_idx", "field", "reason", "value")


# ------------------------------------------------------------- GA operators
def _ordered(spark, sf_dir):
    scored, _ = _scored(spark, embeddings_table(spark, sf_dir, EMB.seed), EMB)
    valid = scored.where(F.col("fitness").isNotNull())
    return materialize(with_ordinal(assign_parts(valid, EMB.n_parts, EMB.seed)), "ordered")


def q_random_partition(spark, sf_dir):
    """Part, order and ordinal of each scored individual."""
    return _ordered(spark, sf_dir).select("individual_id", "part_id", "p", "n", "fitness")


def q_tournament_winners(spark, sf_dir):
    """W2/W3/W5."""
    w = tournament_winners(_ordered(spark, sf_dir), 5)
    return w.select("part_id", "n", "p", "winner_id", "winner_fitness")


def q_tournament_pairs(spark, sf_dir):
    """W4."""
    pr = tournament_pairs(tournament_winners(_ordered(spark, sf_dir), 5), 5)
    return pr.select("part_id", "k", "p1_id", "p2_id")


ORDERS = Setup(n_parts=1)
ORDERS_RANGE = 1000


def q_tournament_ranges(spark, sf_dir):
    """W1-W5 on a part longer than a task: every order is an individual of one
    part, which is cut into ranges of a thousand."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    pop = orders.select(F.lit(1).alias("generation"), F.col("o_orderkey").alias("individual_id"),
                        F.array(F.lit(1)).alias("genome"), F.col("o_totalprice").cast("double").alias("fitness"))
    ranges = ranges_of(orders.count(), ORDERS.n_parts, ORDERS_RANGE)
    ordered = with_ordinal(assign_parts(pop, ORDERS.n_parts, ORDERS.seed, ranges), ranges)
    pairs = tournament_pairs(tournament_winners(ordered, 5, ORDERS_RANGE), 5)
    return pairs.select("part_id", "n", "k", "p1_id", "p2_id")


def q_uniform_crossover(spark, sf_dir):
    """Children of generation 1, before mutation."""
    pr = tournament_pairs(tournament_winners(_ordered(spark, sf_dir), 5), 5)
    kids = uniform_crossover(pr, EMB.seed, 1)
    return kids.select("part_id", "c", genome_text(F.col("genome")).alias("genome_text"))


def q_bit_mutation(spark, sf_dir):
    """The same children after mutation at rate 0.05 (ids of generation 2)."""
    pr = tournament_pairs(tournament_winners(_ordered(spark, sf_dir), 5), 5)
    kids = uniform_crossover(pr, EMB.seed, 1) \
        .withColumn("individual_id", F.col("c").cast("bigint") * EMB.n_parts + F.col("part_id"))
    mutated = bit_mutation(F.col("genome"), EMB.mutation_rate, EMB.seed, F.lit(2), F.col("individual_id"))
    return kids.select("individual_id", genome_text(mutated).alias("genome_text"))


def q_next_generation(spark, sf_dir):
    """Generation 2 from the scored generation 1 (elitism 1, mutation 0.05)."""
    scored, _ = _scored(spark, embeddings_table(spark, sf_dir, EMB.seed), EMB)
    params = EvolveParams(n_parts=EMB.n_parts, seed=EMB.seed, mutation_rate=EMB.mutation_rate, elitism=1)
    nxt = next_generation(scored, 1, params)
    return nxt.select("generation", "individual_id", genome_text(F.col("genome")).alias("genome_text"),
                      "fitness")


def q_elite_per_part(spark, sf_dir):
    """A4/A6."""
    e = elite_per_part(_ordered(spark, sf_dir), 1)
    return e.select("part_id", "n_scored", "individual_id", "fitness")


def q_elites_read_back(spark, sf_dir):
    """Per-part elites written as a table; the global best read from it."""
    from ..sources.population import read_table, write_part
    path = scratch_path(spark, "elites")
    write_part(elite_per_part(_ordered(spark, sf_dir), 1), path, 1)
    best = elite_global(read_table(spark, path))
    return best.select("generation", "best_id", "best_fitness", "n_features", "n_scored")


def q_genome_decode(spark, sf_dir):
    """Genomes of the scored population through their text and back."""
    scored, _ = _scored(spark, embeddings_table(spark, sf_dir, EMB.seed), EMB)
    back = genome_from_text(genome_text(F.col("genome")))
    return scored.select("individual_id", popcount(back).alias("n_selected"), (back == F.col("genome")).alias("same"),
                         F.array_join(back, "").alias("bits"))


def q_unscored_filter(spark, sf_dir):
    """The rows of generation 2 that wait for a fitness."""
    scored, _ = _scored(spark, embeddings_table(spark, sf_dir, EMB.seed), EMB)
    params = EvolveParams(n_parts=EMB.n_parts, seed=EMB.seed, mutation_rate=EMB.mutation_rate, elitism=1)
    return unscored(next_generation(scored, 1, params)).select("generation", "individual_id")


def q_valid_fitness(spark, sf_dir):
    """Fitness printed as text and parsed; what cannot be parsed goes.
    ``legacy`` is the reference's own line test (text that starts with "0.")."""
    scored, _ = _scored(spark, embeddings_table(spark, sf_dir, EMB.seed), EMB)
    text = F.when(F.col("individual_id") % 5 == 0, F.lit("no result")).otherwise(F.col("fitness").cast("string"))
    return scored.select("individual_id", parse_fitness(text).alias("fitness"), legacy_fitness_line(text).alias("legacy")) \
        .where(F.col("fitness").isNotNull())


def q_elite_global(spark, sf_dir):
    """A5/O3/A8 + report line."""
    scored, _ = _scored(spark, embeddings_table(spark, sf_dir, EMB.seed), EMB)
    best = elite_global(scored)
    rep = history_report(best)
    return best.join(rep, "generation").select("generation", "best_id", "best_fitness", "n_features",
                                               "n_scored", "report")


def q_scored_filter(spark, sf_dir):
    """Valid scored rows of generation 1 (NULL fitness dropped)."""
    scored, _ = _scored(spark, embeddings_table(spark, sf_dir, EMB.seed), EMB)
    return nonempty(scored_rows(scored)).select("individual_id", "fitness")


def q_generation_plateau(spark, sf_dir):
    """W6 over the best fitness of generations 1 and 2 (k = 2)."""
    scored, data = _scored(spark, embeddings_table(spark, sf_dir, EMB.seed), EMB)
    params = EvolveParams(n_parts=EMB.n_parts, seed=EMB.seed, mutation_rate=EMB.mutation_rate, elitism=1)
    gen2 = materialize(next_generation(scored, 1, params), "gen2")
    todo = gen2.where(F.col("fitness").isNull())
    scored2 = materialize(with_fitness(gen2, tf.score_population(data, todo).select("individual_id", "fitness")),
                          "scored2")
    hist = elite_global(scored).unionByName(elite_global(scored2))
    return plateau(hist, 2).select("generation", "best_id", "best_fitness", "n_features", "plateau")


def q_search_history(spark, sf_dir):
    """G6 + S9/F14: three generations of the full search loop (score, write,
    elite, plateau test, evolve) on embeddings; the per-generation history."""
    from .search import SearchParams, run_search
    params = SearchParams(population_size=EMB.population, block_size=EMB.block_size, n_bins=EMB.n_bins,
                          max_generations=3, plateau_k=4,
                          evolve=EvolveParams(n_parts=EMB.n_parts, seed=EMB.seed,
                                              mutation_rate=EMB.mutation_rate, elitism=1))
    res = run_search(embeddings_table(spark, sf_dir, EMB.seed), params)
    hist = res.history
    return hist.join(history_report(hist), "generation").select(
        "generation", "best_id", "best_fitness", "n_features", "n_scored", "report")


def q_search_to_plateau(spark, sf_dir):
    """The search on documents until four generations have the same best;
    nothing else ends it."""
    from .search import SearchParams, run_search
    params = SearchParams(population_size=DOCS.population, block_size=DOCS.block_size, n_bins=DOCS.n_bins,
                          max_generations=None, plateau_k=4,
                          evolve=EvolveParams(n_parts=DOCS.n_parts, seed=DOCS.seed,
                                              mutation_rate=DOCS.mutation_rate, elitism=1))
    hist = run_search(documents_table(spark, sf_dir, DOCS.seed), params).history
    return plateau(hist, 4).select("generation", "best_id", "best_fitness", "n_features", "n_scored", "plateau")


# ----------------------------------------------------------- pyspark.ml path
def q_tree_fitness_mllib(spark, sf_dir):
    """ML1/ML3/ML4 via pyspark.ml: DecisionTreeClassifier per (individual,
    block) on the binned columns; equals the batched tree exactly."""
    from ..operators.ml_fitness import prepare_ml, score_population_ml
    t = embeddings_table(spark, sf_dir, EMB.seed)
    data = tf.prepare(t, EMB.block_size, EMB.n_bins)
    ml = prepare_ml(t, data.binned)
    pop = init_population(spark, EMB.population, t.n_features, EMB.seed)
    return score_population_ml(ml, pop, EMB.block_size, "tree")


def q_logistic_fitness(spark, sf_dir):
    """ML2/ML4: multinomial logistic regression of every (individual, block),
    all fitted by the same passes over the data."""
    from ..operators.logistic import prepare_logistic, score_population_logistic
    t = embeddings_table(spark, sf_dir, EMB.seed)
    pop = init_population(spark, EMB.population, t.n_features, EMB.seed)
    scores = score_population_logistic(prepare_logistic(t, EMB.block_size), pop)
    return scores.withColumn("train_loss", F.round("train_loss", 9))


def q_logistic_predictions(spark, sf_dir):
    """ML3: what the logistic model of each (individual, block) says of every test row."""
    from ..operators import logistic as lg
    t = embeddings_table(spark, sf_dir, EMB.seed)
    data = lg.prepare_logistic(t, EMB.block_size)
    pop = init_population(spark, EMB.population, t.n_features, EMB.seed)
    genomes = {r["individual_id"]: list(r["genome"]) for r in pop.collect()}     # population-sized
    own = lg.distinct_models(genomes, data)
    return lg.individual_predictions(data, own).select("row_key", "individual_id", "block", F.col("class").alias("predicted"))


def q_naive_bayes_fitness(spark, sf_dir):
    """Gaussian naive Bayes of every (individual, block)."""
    from ..operators.naive_bayes import prepare_naive_bayes, score_population_naive_bayes
    t = embeddings_table(spark, sf_dir, EMB.seed)
    return score_population_naive_bayes(prepare_naive_bayes(t, EMB.block_size),
                                        init_population(spark, EMB.population, t.n_features, EMB.seed))


QUERIES = {
    "feature_bins": q_feature_bins,
    "class_count": q_class_count,
    "csv_label_attach": q_csv_label_attach,
    "csv_rejects": q_csv_rejects,
    "masked_projection": q_masked_projection,
    "root_histogram": q_root_histogram,
    "root_splits": q_root_splits,
    "tree_fitness_embeddings": q_tree_fitness_embeddings,
    "tree_fitness_lineitem": q_tree_fitness_lineitem,
    "tree_fitness_documents": q_tree_fitness_documents,
    "tree_fitness_many_classes": q_tree_fitness_many_classes,
    "tree_fitness_quantile": q_tree_fitness_quantile,
    "tree_fitness_raw": q_tree_fitness_raw,
    "tree_fitness_wide": q_tree_fitness_wide,
    "tree_predictions": q_tree_predictions,
    "feature_bins_missing": q_feature_bins_missing,
    "elites_read_back": q_elites_read_back,
    "genome_decode": q_genome_decode,
    "unscored_filter": q_unscored_filter,
    "valid_fitness": q_valid_fitness,
    "random_partition": q_random_partition,
    "tournament_winners": q_tournament_winners,
    "tournament_pairs": q_tournament_pairs,
    "tournament_ranges": q_tournament_ranges,
    "uniform_crossover": q_uniform_crossover,
    "bit_mutation": q_bit_mutation,
    "next_generation": q_next_generation,
    "elite_per_part": q_elite_per_part,
    "elite_global": q_elite_global,
    "scored_filter": q_scored_filter,
    "generation_plateau": q_generation_plateau,
    "search_history": q_search_history,
    "search_to_plateau": q_search_to_plateau,
    "tree_fitness_mllib": q_tree_fitness_mllib,
    "logistic_fitness": q_logistic_fitness,
    "logistic_predictions": q_logistic_predictions,
    "naive_bayes_fitness": q_naive_bayes_fitness,
}
