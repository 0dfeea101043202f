"""Elites and the search history.

All are ordinary aggregates: Spark runs them as partial + final
aggregation, which is what the reference does by hand (per-map-task elite
files, then a driver loop over them).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.genome import genome_text, popcount


def elite_per_part(ordered: DataFrame, min_rows: int = 1) -> DataFrame:
    """Best scored individual of each part; ties to the earliest row
    (the reference keeps the first maximum).  Parts with fewer than
    ``min_rows`` scored rows report nothing (the reference uses 10)."""
    s = ordered.where(F.col("fitness").isNotNull())
    best = F.max_by(F.struct(F.col("individual_id").alias("id"), F.col("genome").alias("genome"),
                             F.col("fitness").alias("fitness")),
                    F.struct(F.col("fitness"), -F.col("p")))
    return s.groupBy("part_id").agg(F.count(F.lit(1)).alias("n_scored"), best.alias("b")) \
        .where(F.col("n_scored") >= min_rows) \
        .select("part_id", "n_scored", F.col("b.id").alias("individual_id"),
                F.col("b.genome").alias("genome"), F.col("b.fitness").alias("fitness"))


def elite_global(population: DataFrame) -> DataFrame:
    """A5/O3: one row, the best individual (ties to the lowest id)."""
    s = population.where(F.col("fitness").isNotNull())
    best = F.max_by(F.struct(F.col("individual_id").alias("id"), F.col("genome").alias("genome"),
                             F.col("fitness").alias("fitness")),
                    F.struct(F.col("fitness"), -F.col("individual_id")))
    return s.groupBy("generation").agg(best.alias("b"), F.count(F.lit(1)).alias("n_scored")).select(
        "generation", F.col("b.id").alias("best_id"), F.col("b.genome").alias("best_genome"),
        F.col("b.fitness").alias("best_fitness"), popcount(F.col("b.genome")).alias("n_features"),
        "n_scored")


def top_individuals(population: DataFrame, k: int) -> DataFrame:
    """The ``k`` best scored individuals (fitness desc, id asc) with rank 1..k.

    A top-k (Spark plans a per-partition top-k and a k-row merge).
    """
    top = population.where(F.col("fitness").isNotNull()) \
        .orderBy(F.col("fitness").desc(), F.col("individual_id").asc()).limit(k)
    w = Window.orderBy(F.col("fitness").desc(), F.col("individual_id").asc())
    return top.withColumn("rank", F.row_number().over(w))


def plateau(history: DataFrame, k: int) -> DataFrame:
    """Flag generations whose last ``k`` best fitness values are equal.

    The history has one row per generation, so the un-partitioned window
    holds at most max_generations rows.
    """
    w = Window.orderBy("generation").rowsBetween(-(k - 1), 0)
    return history.withColumn(
        "plateau",
        (F.count(F.lit(1)).over(w) == k) & (F.max("best_fitness").over(w) == F.min("best_fitness").over(w)))


def stop_generation(history: DataFrame, k: int) -> DataFrame:
    """First generation at which the plateau rule fires (one row, NULL if none)."""
    return plateau(history, k).agg(
        F.min(F.when(F.col("plateau"), F.col("generation"))).alias("stop_generation"))


def history_report(history: DataFrame) -> DataFrame:
    """The reference's per-iteration report text."""
    return history.select(
        "generation",
        F.format_string("Iteration = %d\nFinal Individual - %s\nAccuracy = %.9f",
                        F.col("generation"), genome_text(F.col("best_genome")),
                        F.col("best_fitness").cast("double")).alias("report"))
