"""Random partitioning, ordering and the sliding tournament.

The reference scatters individuals with a random partitioner, orders them
with a coin-flip comparator and runs a tournament of size 5 over a circular
buffer in each reducer.  Here each step is a column or a window:

* part_id  = md5(seed|generation|id) prefix mod n_parts        (O2)
* order    = the same md5 digest, then id                       (O1)
* p        = row_number() over (part_id order by digest, id) - 1 (W1)
* winner at p = best of rows p-4..p: max_by over ROWS 4 PRECEDING (W2),
  ties to the lowest buffer slot p % 5 (the reference scans slots 0..4
  with a strict '>').
* no tournament before p = 5 (W3); the first 5 rows are appended again as
  p = n..n+4 so that n rows give n windows (W5, the wrap-around reading
  of the reference's "last round" buffer, see D9/D10).
* winners at p and p-1 are paired when (p - 5) is odd (W4).

Parts smaller than the tournament wrap around more than once.

A part may be longer than a task should hold.  Then it is cut into *ranges*:

* of the digest, whose values are uniform, for the order: a row's ordinal is the
  number of rows in the ranges before (from counts per range) plus its number
  within its range;
* of positions for the tournament: a range also gets the ``size - 1`` rows before
  its first position (a halo), so each window is whole in one range.  A range
  has an even number of positions, so a pair never lies across a border.

The winners do not depend on the number of ranges.  With one range per part
every window is partitioned by part_id, and one shuffle serves all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import hash_key, hex_prefix_int

#: rows of a part that one task orders or lets compete
RANGE_ROWS = 100_000


def ranges_of(rows: int, n_parts: int, range_rows: int = RANGE_ROWS) -> int:
    """Ranges of each part, for a population of ``rows``."""
    return max(1, -(-rows // (max(1, n_parts) * range_rows)))


def assign_parts(population: DataFrame, n_parts: int, seed: int, ranges: int = 1) -> DataFrame:
    """Adds ``part_id``, ``shuffle_key`` and ``range_id`` and co-locates each
    range of a part (O2, O1)."""
    key = hash_key(seed, F.col("generation"), F.col("individual_id"))
    draw = hex_prefix_int(F.col("shuffle_key"))
    parted = population.withColumn("shuffle_key", key) \
        .withColumn("part_id", F.pmod(draw, F.lit(n_parts)).cast("int"))
    if ranges == 1:
        return parted.withColumn("range_id", F.lit(0)).repartition(n_parts, "part_id")
    # equal shares of the 2**32 values of the digest's first 8 digits, in its order
    return parted.withColumn("range_id", F.floor(draw * ranges / F.lit(float(1 << 32))).cast("int")) \
        .repartition(n_parts * ranges, "part_id", "range_id")


def with_ordinal(parted: DataFrame, ranges: int = 1) -> DataFrame:
    """W1 + A6: 0-based arrival order ``p`` and part size ``n``."""
    if ranges == 1:
        w = Window.partitionBy("part_id").orderBy("shuffle_key", "individual_id")
        return parted.withColumn("p", (F.row_number().over(w) - 1).cast("int")) \
            .withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("part_id")).cast("int"))
    # one row per range
    counts = parted.groupBy("part_id", "range_id").agg(F.count(F.lit(1)).alias("m"))
    counts = counts.select("part_id", "range_id",
                           (F.sum("m").over(Window.partitionBy("part_id").orderBy("range_id")) - F.col("m")).alias("before"),
                           F.sum("m").over(Window.partitionBy("part_id")).cast("int").alias("n"))
    w = Window.partitionBy("part_id", "range_id").orderBy("shuffle_key", "individual_id")
    return parted.withColumn("in_range", F.row_number().over(w)).join(counts, ["part_id", "range_id"]) \
        .withColumn("p", (F.col("before") + F.col("in_range") - 1).cast("int")).drop("in_range", "before")


def tournament_winners(ordered: DataFrame, size: int = 5, range_rows: int | None = None) -> DataFrame:
    """One winner per position p = size .. n + size - 1.

    Columns: part_id, range_id, n, p, winner_id, winner_genome, winner_fitness.
    Position q holds row q modulo n, so a part of any size n >= 1 has n
    winners.  Rows are repeated in place (explode, no union): at the positions
    they have, and in each range of ``range_rows`` positions that needs them
    (default: one range), so without ranges the window reuses the part_id
    partitioning of ``ordered``.
    """
    positions = F.sequence(F.col("p"), F.col("n") + F.lit(size - 1), F.col("n"))
    ext = ordered.select("part_id", "n", F.explode(positions).alias("p"), "individual_id", "genome", "fitness")
    if range_rows is None:
        ext, own = ext.withColumn("range_id", F.lit(0)), F.lit(0)
    else:
        length = F.lit(max(2, range_rows + range_rows % 2))
        own = F.floor((F.col("p") - size) / length).cast("int")
        # positions that see this row: its own and the size - 1 after it, from ``size`` on
        first = F.floor((F.greatest(F.col("p"), F.lit(size)) - size) / length).cast("int")
        last = F.floor((F.least(F.col("p"), F.col("n")) - 1) / length).cast("int")
        ext = ext.where("p >= 1").withColumn("range_id", F.explode(F.sequence(first, last)))
    w = Window.partitionBy("part_id", "range_id").orderBy("p").rowsBetween(-(size - 1), 0)
    best = F.max_by(
        F.struct(F.col("individual_id").alias("id"), F.col("genome").alias("genome"),
                 F.col("fitness").alias("fitness")),
        F.struct(F.coalesce(F.col("fitness"), F.lit(-1.0)), -F.pmod(F.col("p"), F.lit(size))),
    ).over(w)
    return ext.select("part_id", "range_id", "n", "p", best.alias("w")) \
        .where((F.col("p") >= size) & (F.col("range_id") == own)).select(
            "part_id", "range_id", "n", "p",
            F.col("w.id").alias("winner_id"), F.col("w.genome").alias("winner_genome"),
            F.col("w.fitness").alias("winner_fitness"))


def tournament_pairs(winners: DataFrame, size: int = 5) -> DataFrame:
    """Consecutive winners paired where (p - size) is odd; an odd part
    leaves its last winner unpaired (``p2_*`` NULL, copied as is).

    Columns: part_id, n, k (pair number), p1_id, p1_genome, p2_id, p2_genome.
    ``p1`` is the reference's ``ind[0]`` (winner at the even position).
    One pass over the winners: pairs and the single come from one filter.
    """
    w = Window.partitionBy("part_id", "range_id").orderBy("p")
    role = F.pmod(F.col("p") - size, F.lit(2))
    staged = winners.select(
        "part_id", "n", "p", "winner_id", "winner_genome",
        F.lag("winner_id").over(w).alias("prev_id"), F.lag("winner_genome").over(w).alias("prev_genome"),
        role.alias("role"))
    single = (F.col("role") == 0) & (F.col("p") == F.col("n") + size - 1)
    paired = F.col("role") == 1
    even = F.pmod(F.col("p"), F.lit(2)) == 0
    first = paired & ~even           # pair whose later winner sits at an odd position
    return staged.where(paired | single).select(
        "part_id", "n", ((F.col("p") - size) / 2).cast("int").alias("k"),
        F.when(first, F.col("prev_id")).otherwise(F.col("winner_id")).alias("p1_id"),
        F.when(first, F.col("prev_genome")).otherwise(F.col("winner_genome")).alias("p1_genome"),
        F.when(paired & even, F.col("prev_id")).when(first, F.col("winner_id")).alias("p2_id"),
        F.when(paired & even, F.col("prev_genome")).when(first, F.col("winner_genome")).alias("p2_genome"))
