"""One generation step as a single DataFrame plan.

scored population g
  -> drop failed rows (P10); a new random genome takes the place of each
  -> random parts + order + ordinal (O2, O1, W1)     [one shuffle on part_id]
  -> sliding tournament with wrap-around (W2-W5)      [windows on part_id]
  -> consecutive pairs, uniform crossover (W4, G2, U1)
  -> bit mutation (G3); children unscored (P15)
  -> optional elitism: the e best of g replace e children picked by hash
= population g+1 (as many rows as population g)
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.genome import random_genome
from ..functions.hashing import hash_key
from ..operators.crossover import bit_mutation, uniform_crossover
from ..operators.elite import top_individuals
from ..operators.selection import (
    RANGE_ROWS, assign_parts, ranges_of, tournament_pairs, tournament_winners, with_ordinal)


@dataclass(frozen=True)
class EvolveParams:
    n_parts: int = 4
    seed: int = 42
    tournament_size: int = 5
    mutation_rate: float = 0.0
    elitism: int = 1
    range_rows: int = RANGE_ROWS     # rows of a part that one task holds; more make ranges


def offspring(scored_pop: DataFrame, generation: int, params: EvolveParams, rows: int | None = None) -> DataFrame:
    """Children of generation ``generation`` (no elitism), ids c * n_parts + part_id.
    ``rows``: size of the population, if it is known."""
    s = params.tournament_size
    valid = scored_pop.where(F.col("fitness").isNotNull())
    ranges = ranges_of(scored_pop.count() if rows is None else rows, params.n_parts, params.range_rows)
    ordered = with_ordinal(assign_parts(valid, params.n_parts, params.seed, ranges), ranges)
    pairs = tournament_pairs(tournament_winners(ordered, s, params.range_rows if ranges > 1 else None), s)
    kids = uniform_crossover(pairs, params.seed, generation) \
        .withColumn("fitness", F.lit(None).cast("double"))
    nxt = generation + 1
    out = kids.select(
        F.lit(nxt).cast("int").alias("generation"),
        (F.col("c").cast("bigint") * params.n_parts + F.col("part_id")).alias("individual_id"),
        "genome", "fitness")
    mutated = bit_mutation(F.col("genome"), params.mutation_rate, params.seed, F.lit(nxt),
                           F.col("individual_id"))
    return out.withColumn("genome", mutated)


#: ids that one task numbers
ID_RANGE = 100_000


def refill(population: DataFrame, generation: int, params: EvolveParams, rows: int, width: int) -> DataFrame:
    """A new random genome for each individual of ``population`` that could not
    be scored, so that the next generation is no smaller.  Ids follow those
    that children can have, in the order of the old ids: the number of failed
    ones in the ranges of ids before, plus the number within the range."""
    failed = population.where(F.col("fitness").isNull()) \
        .select("individual_id", F.floor(F.col("individual_id") / ID_RANGE).alias("r"))
    counts = failed.groupBy("r").agg(F.count(F.lit(1)).alias("m"))      # one row per range
    before = counts.select("r", (F.sum("m").over(Window.orderBy("r")) - F.col("m")).alias("before"))
    nth = F.col("before") + F.row_number().over(Window.partitionBy("r").orderBy("individual_id")) - 1
    nxt = generation + 1
    ids = failed.join(before, "r").select((F.lit(rows * params.n_parts) + nth).cast("bigint").alias("individual_id"))
    return ids.select(
        F.lit(nxt).cast("int").alias("generation"), "individual_id",
        random_genome(width, params.seed, nxt, F.col("individual_id")).alias("genome"),
        F.lit(None).cast("double").alias("fitness"))


def next_generation(scored_pop: DataFrame, generation: int, params: EvolveParams) -> DataFrame:
    """Population of generation + 1 (elites keep their fitness)."""
    size = scored_pop.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("genome")).alias("w")).first()
    kids = offspring(scored_pop, generation, params, size["n"]) \
        .unionByName(refill(scored_pop, generation, params, size["n"], size["w"] or 1))
    e = params.elitism
    if e <= 0:
        return kids
    nxt = generation + 1
    # the e children to replace: lowest md5(seed|g+1|id|elite); e rows, ranked
    drop_key = hash_key(params.seed, F.lit(nxt), F.col("individual_id"), "elite")
    dropped = kids.select("individual_id", drop_key.alias("k")).orderBy("k").limit(e) \
        .withColumn("rank", F.row_number().over(Window.orderBy("k"))).select("individual_id", "rank")
    elites = top_individuals(scored_pop, e).select("rank", "genome", "fitness")
    moved = elites.join(dropped, "rank").select(
        F.lit(nxt).cast("int").alias("generation"), "individual_id", "genome", "fitness")
    kept = kids.join(dropped.select("individual_id"), "individual_id", "left_anti")
    return kept.unionByName(moved)
