"""Population records (DM3) and the row-level operators on them.

Schema: generation int, individual_id bigint, genome array<int>, fitness double.
``fitness`` is NULL while an individual is unscored (D6: the reference uses
0, which cannot be told apart from a real score of 0).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.genome import has_selection, random_genome

POP_COLS = ["generation", "individual_id", "genome", "fitness"]


def init_population(spark: SparkSession, size: int, n_features: int, seed: int,
                    generation: int = 1, n_parts: int | None = None) -> DataFrame:
    """S6 + U2 + G1: ``size`` random genomes, unscored.

    A narrow stage (no shuffle): ``spark.range`` spreads the ids over
    ``n_parts`` tasks and each task draws its genomes from the md5 coin.
    """
    ids = spark.range(0, size, 1, n_parts or spark.sparkContext.defaultParallelism)
    return ids.select(
        F.lit(generation).cast("int").alias("generation"),
        F.col("id").alias("individual_id"),
        random_genome(n_features, seed, generation, F.col("id")).alias("genome"),
        F.lit(None).cast("double").alias("fitness"),
    )


def with_fitness(population: DataFrame, scores: DataFrame) -> DataFrame:
    """Attach scores (individual_id, fitness) to unscored rows; rows
    that already carry a fitness keep it."""
    s = scores.select("individual_id", F.col("fitness").alias("_new"))
    return population.join(s, "individual_id", "left").select(
        "generation", "individual_id", "genome",
        F.coalesce(F.col("fitness"), F.col("_new")).cast("double").alias("fitness"))


def scored(population: DataFrame) -> DataFrame:
    """Rows with a real score (not NULL, not the legacy 0)."""
    return population.where(F.col("fitness").isNotNull() & (F.col("fitness") != 0))


def unscored(population: DataFrame) -> DataFrame:
    """P8 (build form): rows still waiting for a fitness."""
    return population.where(F.col("fitness").isNull())


def nonempty(population: DataFrame) -> DataFrame:
    """Drop genomes that select no feature."""
    return population.where(has_selection(F.col("genome")))


def parse_fitness(text: Column) -> Column:
    """Text -> number; unparsable text becomes NULL (dropped later)."""
    return F.trim(text).try_cast("double")


def legacy_fitness_line(text: Column) -> Column:
    """The reference's test of a printed line.  It loses 1.0 and numbers
    with an exponent; ``parse_fitness`` decides here."""
    return text.startswith("0.")

