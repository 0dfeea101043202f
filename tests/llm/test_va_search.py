import math
import random

import pytest
from evoselect.llm.va_search import search
from pyspark.sql import functions as F


def brute(rows, k):
    ints = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, qv in {i: v for i, v in reversed(ints) if i % 5 == 0}.items():
        best = sorted((-sum(a * b for a, b in zip(qv, v)), i) for i, v in ints if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("bits,block", [(6, 16), (2, 7), (8, 4096)])
def test_equals_brute_force(spark, bits, block):
    rng = random.Random(bits)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(9)]) for i in range(120)]
    rows += [(200 + i, rows[3][1]) for i in range(30)]                      # ties
    rows += [(300, None), (305, [0.1, None]), (310, [float("nan")] * 9), (315, [float("inf")] * 9), (None, [0.1] * 9),
             (320, []), (325, [0.5, 0.5]), (330, [0.0] * 9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("q", F.lit("clash"))
    got = search(df, F.col("vec_id") % 5 == 0, k=4, bits=bits, block=block, query_block=8).collect()
    assert sorted(map(tuple, got)) == brute(rows, 4)


def test_each_row_of_a_repeated_query_id_is_searched(spark):
    rng = random.Random(7)

    def vector():
        return [rng.gauss(0, 0.2) for _ in range(6)]
    rows = [(i, vector()) for i in range(60)]
    rows += [(i, vector()) for i in (5, 5, 10, 15, 20, 7, 7)] + [(25, rows[25][1])] * 3
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    want = []
    for q, v in rows:
        if q % 5 == 0:
            best = sorted((-sum(math.floor(256 * a) * math.floor(256 * b) for a, b in zip(v, x)), i)
                          for i, x in rows if i != q)[:4]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    got = search(df, F.col("vec_id") % 5 == 0, k=4, block=9, query_block=3).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_few_rows_and_none(spark):
    kind = "vec_id long, embedding array<float>"
    asks = F.col("vec_id") % 5 == 0
    assert search(spark.createDataFrame([], kind), asks).collect() == []
    assert search(spark.createDataFrame([(5, [1.0])], kind), asks).collect() == []
    got = search(spark.createDataFrame([(5, [1.0]), (6, [2.0])], kind), asks).collect()
    assert [tuple(r) for r in got] == [(5, 1, 6, 256 * 512)]


def test_large_components_are_exact(spark):
    rng = random.Random(11)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(6)]) for i in range(60)]
    rows += [(100 + i, [rng.choice([1e8, -1e8, 3e12, 0.5]) for _ in range(6)]) for i in range(20)]
    shared = [0.25, -0.5, 0.125, 0.1, 0.2, 0.3]
    rows += [(200 + i, shared) for i in range(40)]                      # a third of all rows
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = search(df, F.col("vec_id") % 5 == 0, k=4, block=16, query_block=8).collect()
    edge = 2**63 - 1
    assert sorted(map(tuple, got)) == [(q, r, v, max(-edge, min(edge, s))) for q, r, v, s in brute(rows, 4)]
    more = df.union(spark.createDataFrame([(300, [1e300, 1.0, 0.0, 0.0, 0.0, 0.0])], df.schema))
    assert search(more, F.col("vec_id") == 300, k=2).count() == 2


def test_equal_vectors_of_repeated_and_of_own_ids(spark):
    rng = random.Random(3)
    pool = [[rng.choice([-0.5, 0.25, 0.5]) for _ in range(3)] for _ in range(6)]
    rows = [(rng.choice([0, 5, 10, 11, 12, 13, 14]), rng.choice(pool)) for _ in range(90)] + [(20 + i, pool[0]) for i in range(9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    want = []
    for q, v in rows:
        if q % 5 == 0:
            best = sorted((-sum(math.floor(256 * a) * math.floor(256 * b) for a, b in zip(v, x)), i)
                          for i, x in rows if i != q)[:5]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    got = search(df, F.col("vec_id") % 5 == 0, k=5, block=2, query_block=7).collect()
    assert sorted(map(tuple, got)) == sorted(want)
