"""Connected components of a link table, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def connected_components(links: DataFrame) -> DataFrame:
    """(node, comp) for every node of ``links`` (x, y): the smallest node that
    links reach.

    Rounds of large-star and small-star: each node points its larger
    neighbours, then the rest, at the smallest node it sees.  Minima are
    aggregated before the shuffle, so a node with any number of links is a
    few rows for each task.  A round is written to the shared folder; rounds
    grow with the logarithm of the longest path.
    """
    edges = materialize(links.where("x <> y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v"))
                        .distinct(), "edges")
    while True:
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .where("u <> v").distinct()
        # every edge of ``large`` goes from a node to a smaller one
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(
            F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")),
                              F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")) \
            .select("e.u", "e.v").where("u <> v").distinct()
        new = materialize(small, "edges")
        # stars: no centre points on, nobody points twice
        many = new.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        chained = new.join(new.select(F.col("u").alias("v")), "v", "left_semi")
        edges = new
        if many.isEmpty() and chained.isEmpty():
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")) \
        .union(edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
