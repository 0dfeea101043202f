"""The search loop (G6): score, record, test the stop rule, evolve.

Per generation the driver receives one row (the best individual) and one
flag (plateau).  Each scored generation is written to the shared checkpoint
folder and read back, which cuts the lineage: a lost executor re-reads the
last generation instead of replaying the run.

Child histograms are memoised by root feature: a root's threshold never
changes, so a root seen in an earlier generation costs nothing again; a
generation that introduces no new root reads no data at all.
"""

from __future__ import annotations

import json
import time
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.genome import genome_text
from ..operators import tree_fitness as tf
from ..operators.elite import elite_global, elite_per_part, stop_generation
from ..operators.selection import assign_parts, ranges_of, with_ordinal
from ..operators.histogram import child_histogram
from ..operators.ml_fitness import model_family
from ..operators.population import init_population, with_fitness
from ..session import scratch_path
from ..sources.datasets import LabeledTable
from ..sources.population import committed, read_table, write_part
from .generation import EvolveParams, next_generation


@dataclass(frozen=True)
class SearchParams:
    population_size: int = 40
    block_size: int = 16
    n_bins: int = 32
    max_generations: int | None = None     # None: until the plateau
    plateau_k: int = 4
    # X5/P17: "tree" is the batched tree, a name with l the batched logistic
    # regression, one with n naive Bayes, one with d a pyspark.ml tree per (individual, block)
    model: str = "tree"
    elite_min_rows: int = 1        # D8: the reference reports a part only from 10 scored rows
    fitness_memo: bool = True      # reuse the fitness of a genome scored in an earlier generation
    evolve: EvolveParams = field(default_factory=EvolveParams)


@dataclass
class SearchResult:
    workdir: str
    generations: int
    stopped_on_plateau: bool
    history: DataFrame
    seconds: float


class TreeScorer:
    """Batched tree fitness with a root-keyed child-histogram memo.

    Each round writes the child histogram of its *new* root features once;
    best child splits are derived from the written histogram, and later
    rounds read all written rounds back.
    """

    def __init__(self, table: LabeledTable, block_size: int, n_bins: int, workdir: str):
        self.spark: SparkSession = table.df.sparkSession
        self.workdir = workdir
        self.data = tf.prepare(table, block_size, n_bins, workdir=f"{workdir}/data")
        self._rounds: list[str] = []

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(*[f"{r}/{name}" for r in self._rounds])

    def score(self, population: DataFrame) -> DataFrame:
        """(individual_id, correct, n_blocks_used, fitness) for ``population``."""
        g = tf.genes(population, self.data.block_size)
        roots = tf.needed_roots(tf.root_choices(self.data, g))
        if self._rounds:
            roots = roots.join(self._read("roots").select("r"), "r", "left_anti")
        rnd = f"{self.workdir}/memo/round_{len(self._rounds) + 1}"
        roots.select("r", "t_r", "block").write.mode("overwrite").parquet(f"{rnd}/roots")
        fresh = self.spark.read.parquet(f"{rnd}/roots")
        if fresh.count() > 0:                 # at most one row per feature
            child_histogram(self.data.binned, fresh, self.data.block_size, self.data.n_features,
                            self.data.root_hist, self.data.spec.n_bins + 1) \
                .write.mode("overwrite").parquet(f"{rnd}/child_hist")
            hist = self.spark.read.parquet(f"{rnd}/child_hist")
            best, nodes = tf.child_tables(self.data, hist)
            best.write.mode("overwrite").parquet(f"{rnd}/child_best")
            nodes.write.mode("overwrite").parquet(f"{rnd}/node_correct")
            self._rounds.append(rnd)
        if not self._rounds:                   # no block had a useful root split
            empty_b = self.spark.createDataFrame([], "node int, f int, t int, score double, correct bigint")
            empty_n = self.spark.createDataFrame([], "node int, correct bigint")
            return tf.score_population(self.data, population, empty_b, empty_n)
        return tf.score_population(self.data, population, self._read("child_best"), self._read("node_correct"))


class ModelScorer:
    """Fitness through a pyspark.ml model per (individual, block).

    The vectorised dataset is written once; only genomes reach the driver."""

    def __init__(self, table: LabeledTable, block_size: int, kind: str, parallelism: int = 8):
        from ..operators.ml_fitness import prepare_ml
        self.data = prepare_ml(table)
        self.block_size = block_size
        self.kind = kind
        self.parallelism = parallelism

    def score(self, population: DataFrame) -> DataFrame:
        from ..operators.ml_fitness import score_population_ml
        return score_population_ml(self.data, population, self.block_size, self.kind, self.parallelism)


class LogisticScorer:
    """Batched logistic regression: all models of a generation share the passes."""

    def __init__(self, table: LabeledTable, block_size: int):
        from ..operators.logistic import prepare_logistic
        self.data = prepare_logistic(table, block_size)

    def score(self, population: DataFrame) -> DataFrame:
        from ..operators.logistic import score_population_logistic
        return score_population_logistic(self.data, population)


class NaiveBayesScorer:
    """Gaussian naive Bayes: the statistics of the whole table serve every generation."""

    def __init__(self, table: LabeledTable, block_size: int):
        from ..operators.naive_bayes import prepare_naive_bayes
        self.data = prepare_naive_bayes(table, block_size)

    def score(self, population: DataFrame) -> DataFrame:
        from ..operators.naive_bayes import score_population_naive_bayes
        return score_population_naive_bayes(self.data, population)


#: what scores a population, by the model's family; each gathers its statistics once
#: per run and has score(population) -> (individual_id, ..., fitness)
BATCHED = {"logistic": LogisticScorer, "bayes": NaiveBayesScorer}


def _scorer(table: LabeledTable, params: SearchParams, workdir: str):
    """What scores a population, by the model's name."""
    if params.model == "tree":
        return TreeScorer(table, params.block_size, params.n_bins, workdir)
    family = model_family(params.model)
    return BATCHED[family](table, params.block_size) if family in BATCHED \
        else ModelScorer(table, params.block_size, family)


def _fingerprint(table: LabeledTable, params: SearchParams) -> str:
    """What a run depends on: parameters, features and the rows of the table."""
    rows = table.df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("row_key", "label", "is_test", "features")
                        .cast("decimal(38,0)")).alias("h")).first()
    fixed = {k: v for k, v in asdict(params).items() if k not in ("max_generations", "fitness_memo")}
    return json.dumps({"params": fixed, "features": list(table.feature_names), "rows": rows["n"],
                       "hash": str(rows["h"])}, sort_keys=True)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _start(spark: SparkSession, workdir: str, mark: str) -> int:
    """First generation to run in ``workdir``: 1 in a new folder, the one after
    the last full generation in a folder of the same run.  A folder of another
    run (other data or parameters) is refused."""
    run = f"{workdir}/run"
    if not _exists(spark, f"{run}/_SUCCESS"):
        spark.createDataFrame([(mark,)], "mark string").coalesce(1).write.mode("overwrite").text(run)
        return 1
    if spark.read.text(run, wholetext=True).first()[0].strip() != mark:
        raise ValueError(f"{workdir} belongs to a run with other data or parameters")
    whole = committed(spark, f"{workdir}/history")
    g = 1
    while g in whole:
        g += 1
    return g


def run_search(table: LabeledTable, params: SearchParams, workdir: str | None = None,
               log=None) -> SearchResult:
    """Run, or go on with, the search in ``workdir`` until the plateau (or
    ``max_generations``, if given).

    A generation of a table is there as a whole or not at all; the history row
    comes last, so a generation counts only when all its tables are whole, and
    a run that was stopped goes on to the same history."""
    spark = table.df.sparkSession
    workdir = workdir or scratch_path(spark, "search")
    t0 = time.time()
    model_family(params.model)          # an unknown name is refused before anything is written
    first = _start(spark, workdir, _fingerprint(table, params))
    hist_path, memo_root = f"{workdir}/history", f"{workdir}/fitness_memo"

    def stopped() -> bool:
        return stop_generation(read_table(spark, hist_path), params.plateau_k).first()[0] is not None

    def result(g: int, plateau: bool) -> SearchResult:
        return SearchResult(workdir, g, plateau, read_table(spark, hist_path).orderBy("generation"), time.time() - t0)

    if first > 1:
        done = first - 1
        if stopped():
            return result(done, True)
        if params.max_generations is not None and done >= params.max_generations:
            return result(done, False)
    scorer = _scorer(table, params, workdir)

    def read_scored(g: int) -> DataFrame:
        return read_table(spark, f"{workdir}/population", g).select(
            F.lit(g).alias("generation"), "individual_id", "genome", "fitness")

    g = first
    while True:
        if g == 1:
            pop = init_population(spark, params.population_size, table.n_features, params.evolve.seed)
        else:
            # offspring are read by several jobs of the round: write once
            write_part(next_generation(read_scored(g - 1), g - 1, params.evolve), f"{workdir}/offspring", g)
            pop = read_table(spark, f"{workdir}/offspring", g).select(
                F.lit(g).alias("generation"), "individual_id", "genome", "fitness")
        todo = pop.where(F.col("fitness").isNull())
        known = None
        if params.fitness_memo and g > 1:
            # fitness is a function of the genome: a genome scored before is not
            # scored again (clones, copied winners).  The memo holds one row per
            # distinct genome scored so far (population x generations, a run bound).
            memo = read_table(spark, memo_root).where(F.col("generation") < g) \
                .select("gkey", "fitness").dropDuplicates(["gkey"])
            keyed = todo.withColumn("gkey", F.md5(genome_text(F.col("genome"))))
            known = keyed.drop("fitness").join(memo, "gkey").select("individual_id", "fitness")
            todo = keyed.join(memo.select("gkey"), "gkey", "left_anti").drop("gkey")
        scores = scorer.score(todo).select("individual_id", "fitness")
        if known is not None:
            scores = scores.unionByName(known)
        write_part(with_fitness(pop, scores), f"{workdir}/population", g)
        scored = read_scored(g)
        if params.fitness_memo:
            fresh = pop.where(F.col("fitness").isNull()).select("individual_id")
            write_part(scored.join(fresh, "individual_id")
                       .select(F.md5(genome_text(F.col("genome"))).alias("gkey"), "fitness"), memo_root, g)
        # Per-part elites of the parts this generation is bred in; S8/A5:
        # the global best is the final step of the same two-phase argmax
        ranges = ranges_of(params.population_size, params.evolve.n_parts, params.evolve.range_rows)
        parted = with_ordinal(assign_parts(scored, params.evolve.n_parts, params.evolve.seed, ranges), ranges)
        write_part(elite_per_part(parted, params.elite_min_rows), f"{workdir}/elites", g)
        write_part(elite_global(scored), hist_path, g)
        if log:
            b = read_table(spark, hist_path).where(F.col("generation") == g).first()
            log(f"generation {g}: best {b['best_fitness']:.6f} ({b['n_features']} features)")
        if stopped():
            return result(g, True)
        if params.max_generations is not None and g >= params.max_generations:
            return result(g, False)
        g += 1
