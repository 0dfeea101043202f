"""Uniform crossover, bit mutation and child emission.

Per position a fair md5 coin keeps the parents' bits (child 1 from parent
1, child 2 from parent 2) or swaps them; so the two children are
complementary: c1[i] + c2[i] = p1[i] + p2[i] everywhere.  An unpaired
winner is copied unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import coin, uniform


def uniform_crossover(pairs: DataFrame, seed: int, generation: int) -> DataFrame:
    """pairs (part_id, n, k, p1_genome, p2_genome) -> children (part_id, c, genome).

    Child numbers within a part: 2k and 2k+1; a copied single keeps 2k.
    """
    def keep(i):
        return coin(seed, generation, "x", F.col("part_id"), F.col("k"), i) == 1

    p1, p2 = F.col("p1_genome"), F.col("p2_genome")
    c1 = F.transform(p1, lambda a, i: F.when(keep(i), a).otherwise(F.element_at(p2, i + 1)))
    c2 = F.transform(p2, lambda b, i: F.when(keep(i), b).otherwise(F.element_at(p1, i + 1)))
    two = F.array(
        F.struct((F.col("k") * 2).alias("c"), c1.alias("genome")),
        F.struct((F.col("k") * 2 + 1).alias("c"), c2.alias("genome")),
    )
    one = F.array(F.struct((F.col("k") * 2).alias("c"), p1.alias("genome")))
    kids = pairs.select("part_id", F.explode(F.when(p2.isNotNull(), two).otherwise(one)).alias("kid"))
    return kids.select("part_id", F.col("kid.c").cast("int").alias("c"), F.col("kid.genome").alias("genome"))


def bit_mutation(genome, rate: float, seed: int, generation, individual_id):
    """Flip each bit with probability ``rate`` (draw keyed by seed, generation,
    id and position).  ``rate = 0`` is the identity, as in the reference code."""
    if rate <= 0:
        return genome
    return F.transform(
        genome,
        lambda b, i: F.when(uniform(seed, generation, individual_id, "m", i) < F.lit(float(rate)),
                            F.lit(1) - b).otherwise(b))
