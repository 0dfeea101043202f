"""Labeled feature tables (DM7-DM9) built from the given parquet tables.

A :class:`LabeledTable` is one DataFrame with columns

    row_key   string     stable key of the row (used for the hold-out draw)
    label     any order  class of the row
    is_test   boolean    hold-out membership
    features  array<double>

plus the number and names of its features.  Nothing is collected: the
hold-out draw is a hash of the row key, so train/test membership does not
depend on partitioning.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import bucket


@dataclass(frozen=True)
class LabeledTable:
    df: DataFrame
    feature_names: tuple[str, ...]

    @property
    def n_features(self) -> int:
        return len(self.feature_names)


def holdout_flag(seed: int, key: Column, test_parts: int = 1, n_parts: int = 5) -> Column:
    """Row goes to the test side when md5(seed|holdout|key) lands in the first
    ``test_parts`` of ``n_parts`` buckets (default 1 in 5)."""
    return bucket(n_parts, seed, "holdout", key) < F.lit(test_parts)


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embeddings_table(spark: SparkSession, sf_dir: str, seed: int = 42,
                     n_features: int | None = None) -> LabeledTable:
    """``embeddings``: the vector is the feature row, ``label`` the class."""
    emb = _read(spark, sf_dir, "embeddings")
    if n_features is None:
        # one scalar: the vector width, needed to name the features
        n_features = int(emb.select(F.max(F.size("embedding"))).first()[0])
    df = emb.select(
        F.col("vec_id").cast("string").alias("row_key"),
        F.col("label"),
        holdout_flag(seed, F.col("vec_id")).alias("is_test"),
        F.transform("embedding", lambda x: x.cast("double")).alias("features"),
    )
    return LabeledTable(df, tuple(f"e{i}" for i in range(n_features)))


def wide_table(spark: SparkSession, sf_dir: str, seed: int = 42, n_features: int = 760,
               width: int = 64) -> LabeledTable:
    """``embeddings`` widened: feature k is the product of the k-th pair of
    components (i <= j, ordered by i and j)."""
    pairs = [(i, j) for i in range(width) for j in range(i, width)][:n_features]
    e = embeddings_table(spark, sf_dir, seed, width)
    left, right = F.lit([i + 1 for i, _ in pairs]), F.lit([j + 1 for _, j in pairs])
    # a shorter vector counts as padded with zeros
    at = lambda k: F.coalesce(F.try_element_at("features", k), F.lit(0.0))
    wide = F.transform(left, lambda i, k: at(i) * at(F.element_at(right, k + 1)))
    return LabeledTable(e.df.withColumn("features", wide), tuple(f"p{i}_{j}" for i, j in pairs))


# fixed values: the numeric lineitem columns used as features, in this order
LINEITEM_FEATURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax",
                     "l_linenumber", "ship_day")


def lineitem_table(spark: SparkSession, sf_dir: str, seed: int = 42,
                   label: str = "l_returnflag") -> LabeledTable:
    """``lineitem`` numeric columns (ship date as a day number) -> ``label``."""
    li = _read(spark, sf_dir, "lineitem")
    cols = {
        "l_quantity": F.col("l_quantity"),
        "l_extendedprice": F.col("l_extendedprice"),
        "l_discount": F.col("l_discount"),
        "l_tax": F.col("l_tax"),
        "l_linenumber": F.col("l_linenumber"),
        "ship_day": F.unix_date(F.to_date("l_shipdate")),
    }
    key = F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    df = li.select(
        key.alias("row_key"),
        F.col(label).alias("label"),
        holdout_flag(seed, key).alias("is_test"),
        F.array(*[cols[c].cast("double") for c in LINEITEM_FEATURES]).alias("features"),
    )
    return LabeledTable(df, LINEITEM_FEATURES)


def _count_chars(text: Column, pattern: str) -> Column:
    """Occurrences of single ASCII characters matching ``pattern`` (in bytes,
    so the count does not depend on how characters are counted)."""
    return F.octet_length(text) - F.octet_length(F.regexp_replace(text, pattern, ""))


# fixed values: text-count features of a document, in this order
DOCUMENT_FEATURES = ("n_chars", "n_bytes", "n_lines", "n_spaces", "n_digits",
                     "n_upper", "n_punct")


def documents_table(spark: SparkSession, sf_dir: str, seed: int = 42,
                    label: str = "quality") -> LabeledTable:
    """Whole-text counts of each labeled document -> ``labels.<label>``."""
    docs = _read(spark, sf_dir, "documents")
    labels = _read(spark, sf_dir, "labels")
    text = F.col("text")
    cols = [
        F.col("n_chars"),
        F.octet_length(text),
        _count_chars(text, "\n") + F.lit(1),
        _count_chars(text, " "),
        _count_chars(text, "[0-9]"),
        _count_chars(text, "[A-Z]"),
        _count_chars(text, "[.,;:!?]"),
    ]
    # labels has one row per doc_id: the join keeps every labeled document once
    joined = docs.join(labels.select("doc_id", F.col(label).alias("label")), "doc_id")
    df = joined.select(
        F.col("doc_id").cast("string").alias("row_key"),
        F.col("label"),
        holdout_flag(seed, F.col("doc_id")).alias("is_test"),
        F.array(*[c.cast("double") for c in cols]).alias("features"),
    )
    return LabeledTable(df, DOCUMENT_FEATURES)


TABLES = {
    "embeddings": embeddings_table,
    "lineitem": lineitem_table,
    "documents": documents_table,
}
