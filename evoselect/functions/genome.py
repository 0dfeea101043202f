"""Column functions on genomes (``array<int>`` of 0/1, one bit per feature).

All of them are built-in higher-order array expressions; none is a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .hashing import coin

GENOME_SEP = "|"


def random_genome(n_features: int, seed: int, generation, individual_id) -> Column:
    """G1: fair random bit per position, keyed by (seed, generation, id, pos)."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(n_features - 1)),
        lambda pos: coin(seed, generation, individual_id, pos),
    )


def genome_text(genome) -> Column:
    """``b0|b1|...|`` with a trailing separator."""
    return F.concat(F.array_join(genome, GENOME_SEP), F.lit(GENOME_SEP))


def genome_from_text(text) -> Column:
    """P5: decode ``b0|b1|...|``; '0' is 0, any other symbol is 1."""
    body = F.regexp_replace(text, r"\|$", "")
    return F.transform(F.split(body, r"\|"),
                       lambda s: F.when(s == F.lit("0"), F.lit(0)).otherwise(F.lit(1)))


def popcount(genome) -> Column:
    """Number of selected features."""
    return F.aggregate(genome, F.lit(0), lambda acc, b: acc + b)


def has_selection(genome) -> Column:
    """Genome selects at least one feature."""
    return F.exists(genome, lambda b: b == F.lit(1))


def block_popcounts(genome, n_features: int, block_size: int) -> Column:
    """Selected-feature count per block, as an array of length n_blocks."""
    n_blocks = -(-n_features // block_size)
    return F.transform(
        F.sequence(F.lit(0), F.lit(n_blocks - 1)),
        lambda k: F.aggregate(F.slice(genome, k * block_size + 1, F.lit(block_size)),
                              F.lit(0), lambda acc, b: acc + b),
    )


def every_block_selected(genome, n_features: int, block_size: int) -> Column:
    """Every block keeps at least one feature (else no tree can be fit)."""
    return F.forall(block_popcounts(genome, n_features, block_size), lambda c: c > F.lit(0))
