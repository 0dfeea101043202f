"""Headerless feature CSV + one-label-per-line files.

The reference keeps the two files aligned by line number and collects the
labels to the driver.  Here each file gets an explicit dense row index in
file and line order (computed JVM-side from the scan's split and position)
and the two are joined on it, so nothing is collected and the alignment
holds however the files are split into tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize
from .datasets import LabeledTable


def _indexed_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with a dense 0-based index, in the order of file path and place
    in the file, whatever order Spark scans the files in.

    Lines of one block of a file are neighbours in one task, so their position
    is their id minus the block's smallest id.  A block's offset is a two-level
    running sum: lines of earlier files, then of earlier blocks of the file.
    The first level has one row per file.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("id"), "value")
    blocks = lines.groupBy("file", "start").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    inside = blocks.withColumn(
        "before", F.sum("n").over(Window.partitionBy("file").orderBy("start")) - F.col("n"))
    files = blocks.groupBy("file").agg(F.sum("n").alias("lines"))
    files = files.select("file", (F.sum("lines").over(Window.orderBy("file")) - F.col("lines")).alias("earlier"))
    offsets = inside.join(files, "file").select("file", "start", "earlier", (F.col("before") - F.col("first")).alias("shift"))
    line = F.col("id") + F.col("shift")
    return lines.join(offsets, ["file", "start"]).select(
        (line + F.col("earlier")).alias("row_idx"), "value", "file", (line + 1).alias("line"))


def read_feature_csv(spark: SparkSession, path: str) -> DataFrame:
    """(row_idx, features array<double>); P1 split on ',' and P2 cast, which
    fails on unparsable text like the reference."""
    return _indexed_lines(spark, path).select(
        "row_idx", F.transform(F.split("value", ","), lambda s: F.trim(s).cast("double")).alias("features"))


def _fields(lines: DataFrame) -> DataFrame:
    """``lines`` with their texts and values by field; a text that is no number has the value NULL."""
    texts = F.transform(F.split("value", ","), lambda s: F.trim(s))
    return lines.withColumn("texts", texts).withColumn("features", F.transform("texts", lambda s: s.try_cast("double")))


def read_feature_csv_lenient(spark: SparkSession, path: str, n_features: int) -> tuple[DataFrame, DataFrame]:
    """P2 with ``try_cast``: (rows, rejects).

    ``rows`` (row_idx, features array<double>) has every line, so labels still
    belong to their lines: a field that is no number is NULL, and a line whose
    number of fields is not ``n_features`` has NULL features.  ``rejects`` (file,
    line, row_idx, field, reason, value) says what was wrong and where, lines and fields
    counted from 1: one row per bad field (reason "number"), or one per bad line
    (field NULL, reason "fields", value the number of fields)."""
    lines = _fields(_indexed_lines(spark, path))
    whole = F.size("texts") == n_features
    rows = lines.select("row_idx", F.when(whole, F.col("features")).alias("features"))
    fields = F.filter(F.transform("texts", lambda t, i: F.struct((i + 1).alias("field"), F.lit("number").alias("reason"), t.alias("value"))),
                      lambda x: F.element_at("features", x["field"]).isNull())
    line = F.array(F.struct(F.lit(None).cast("int").alias("field"), F.lit("fields").alias("reason"),
                            F.size("texts").cast("string").alias("value")))
    rejects = lines.select("file", "line", "row_idx", F.explode(F.when(whole, fields).otherwise(line)).alias("r")) \
        .select("file", "line", "row_idx", "r.field", "r.reason", "r.value")
    return rows, rejects


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(row_idx, label double): one class id per line."""
    return _indexed_lines(spark, path).select("row_idx", F.trim("value").cast("double").alias("label"))


def attach_labels(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Row i of the data file gets line i of the label file.  A line
    without its partner is an error, not a lost row."""
    both = features.withColumn("_x", F.lit(1)).join(labels.withColumn("_y", F.lit(1)), "row_idx", "full_outer")
    alone = F.col("_x").isNull() | F.col("_y").isNull()
    return both.select("row_idx", "features", F.when(alone, F.raise_error(F.lit(
        "data file and label file differ in their number of lines")).cast("double")).otherwise(F.col("label")).alias("label"))


def csv_table(spark: SparkSession, train_data: str, train_labels: str, test_data: str,
              test_labels: str, n_features: int | None = None) -> LabeledTable:
    """The four-file layout -> LabeledTable (test rows use the test labels, D3)."""
    tr = attach_labels(read_feature_csv(spark, train_data), read_labels(spark, train_labels)) \
        .withColumn("is_test", F.lit(False))
    te = attach_labels(read_feature_csv(spark, test_data), read_labels(spark, test_labels)) \
        .withColumn("is_test", F.lit(True))
    df = tr.unionByName(te).select(
        F.concat(F.when(F.col("is_test"), F.lit("test:")).otherwise(F.lit("train:")),
                 F.col("row_idx").cast("string")).alias("row_key"),
        "label", "is_test", "features")
    df = materialize(df, "csv")      # the files are indexed and joined once
    if n_features is None:
        n_features = int(df.select(F.max(F.size("features"))).first()[0])
    return LabeledTable(df, tuple(f"c{i}" for i in range(n_features)))


#: rows that a file holds at most, nearly
ROWS_PER_FILE = 1_000_000


def write_csv_pair(table: LabeledTable, data_path: str, label_path: str, test: bool,
                   data_files: int = 3, label_files: int = 5, rows_per_file: int = ROWS_PER_FILE) -> None:
    """Write one side of a table in the four-file layout, as ordered folders of
    about so many files, and one more for every ``rows_per_file`` rows.

    Both folders are in the order of all columns, so rows that tie are equal
    and line i of one folder belongs to line i of the other."""
    order = ["row_key", "label", "features"]
    side = table.df.where(F.col("is_test") == F.lit(test)).select(*order)
    more = side.count() // rows_per_file

    def ordered(files: int) -> DataFrame:
        return side.repartitionByRange(files, *order).sortWithinPartitions(*order)
    ordered(data_files + more).select(F.array_join(F.transform("features", lambda x: x.cast("string")), ",").alias("value")) \
        .write.mode("overwrite").text(data_path)
    ordered(label_files + more).select(F.col("label").cast("string").alias("value")).write.mode("overwrite").text(label_path)
