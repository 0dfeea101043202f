import hashlib

from pyspark.sql import functions as F

from evoselect.functions.genome import (block_popcounts, every_block_selected, genome_from_text,
                                        genome_text, has_selection, popcount, random_genome)
from evoselect.functions.hashing import bucket, coin, uniform


def _py_coin(*parts):
    h = hashlib.md5("|".join(str(p) for p in parts).encode()).hexdigest()
    return 1 if h[0] >= "8" else 0


def test_coin_matches_md5_rule(spark):
    df = spark.range(0, 50).select("id", coin(42, 1, F.col("id"), 3).alias("c"))
    for r in df.collect():
        assert r["c"] == _py_coin(42, 1, r["id"], 3)


def test_uniform_and_bucket(spark):
    r = spark.range(0, 200).select(uniform(7, F.col("id")).alias("u"), bucket(5, 7, F.col("id")).alias("b"))
    rows = r.collect()
    assert all(0.0 <= x["u"] < 1.0 for x in rows)
    assert {x["b"] for x in rows} == {0, 1, 2, 3, 4}
    h = hashlib.md5(b"7|0").hexdigest()
    assert rows[0]["b"] == int(h[:8], 16) % 5
    assert abs(rows[0]["u"] - int(h[:8], 16) / 2 ** 32) < 1e-15


def test_random_genome_and_text_roundtrip(spark):
    df = spark.range(0, 8).select("id", random_genome(20, 42, 1, F.col("id")).alias("g"))
    df = df.select("id", "g", genome_text("g").alias("t")).select(
        "id", "g", "t", genome_from_text("t").alias("back"), popcount("g").alias("pc"),
        has_selection("g").alias("ne"), block_popcounts("g", 20, 8).alias("bc"),
        every_block_selected("g", 20, 8).alias("all_blocks"))
    for r in df.collect():
        expected = [_py_coin(42, 1, r["id"], i) for i in range(20)]
        assert r["g"] == expected
        assert r["t"] == "".join(f"{b}|" for b in expected)
        assert r["back"] == expected
        assert r["pc"] == sum(expected)
        assert r["ne"] == (sum(expected) > 0)
        assert r["bc"] == [sum(expected[0:8]), sum(expected[8:16]), sum(expected[16:20])]
        assert r["all_blocks"] == all(c > 0 for c in r["bc"])


def test_text_decode_non_zero_symbols_are_one(spark):
    df = spark.createDataFrame([("0|1|2|0|x|",)], "t string")
    assert df.select(genome_from_text("t")).first()[0] == [0, 1, 1, 0, 1]
