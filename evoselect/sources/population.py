"""Population, elite and history storage.

Every table of a run is a folder of *attempts* and a manifest:

    <table>/data/generation=<g>/attempt=<k>/part-*.parquet
    <table>/manifest/<g>.<k>

An attempt is written to a folder of its own and becomes the generation's rows
when its manifest entry, an empty file that must not exist before, is created.
Readers list the manifest and read only the folders it names, the last attempt
of each generation.  So a generation is there as a whole or not at all: a write
that stops half way leaves a folder that nobody reads, a replaced generation
stays readable for those who have listed it, and of two writers of one attempt
one gets the next number.  Reading generation N opens its folder only.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def committed(spark: SparkSession, path: str) -> dict[int, str]:
    """The folder of each whole generation of a table."""
    folder, fs = _path(spark, f"{path}/manifest")
    if not fs.exists(folder):
        return {}
    last: dict[int, tuple[int, str]] = {}
    for entry in fs.listStatus(folder):
        generation, attempt, key = entry.getPath().getName().split(".", 2)
        g, k = int(generation), int(attempt)
        last[g] = max(last.get(g, (-1, "")), (k, key))
    return {g: f"{path}/data/generation={g}/attempt={key}" for g, (_, key) in sorted(last.items())}


def _commit(spark: SparkSession, path: str, generation: int, key: str) -> None:
    folder, fs = _path(spark, f"{path}/manifest")
    fs.mkdirs(folder)
    while True:
        taken = [int(e.getPath().getName().split(".")[1]) for e in fs.listStatus(folder)
                 if e.getPath().getName().startswith(f"{generation}.")]
        entry, _ = _path(spark, f"{path}/manifest/{generation}.{max(taken, default=0) + 1}.{key}")
        if fs.createNewFile(entry):
            return


def write_part(df: DataFrame, path: str, generation: int) -> None:
    """Replace one generation's rows (population, elites, history, memo)
    of a table, so a generation that runs again leaves no second copy."""
    key = uuid.uuid4().hex[:12]
    df.drop("generation").write.parquet(f"{path}/data/generation={generation}/attempt={key}")
    _commit(df.sparkSession, path, generation, key)


def read_table(spark: SparkSession, path: str, generation: int | None = None) -> DataFrame:
    """Every whole generation of a table, or one of them."""
    folders = committed(spark, path)
    if generation is not None:
        folders = {g: f for g, f in folders.items() if g == generation}
    if not folders:
        raise FileNotFoundError(f"{path} has no whole generation" + ("" if generation is None else f" {generation}"))
    return spark.read.option("basePath", f"{path}/data").parquet(*folders.values()).drop("attempt") \
        .withColumn("generation", F.col("generation").cast("int"))
