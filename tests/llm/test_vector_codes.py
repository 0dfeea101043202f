import itertools
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from evoselect.llm.vector_codes import codebooks_sha256, compress, hilbert_keys, nearest, scaled, shortlist
from pyspark.sql import functions as F


def plain(rows, parts, entries, rounds, scale):
    """[(id, code, error, label_error)] and the codebooks, in Python's integers."""
    kept = [(i, v, lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max(1, -(-max(len(v) for _, v, _ in kept) // parts)) * parts
    from fractions import Fraction
    ints = [[math.floor(Fraction(x) * scale) for x in v] + [0] * (width - len(v)) for _, v, _ in kept]
    dims = width // parts
    first = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))[:entries]
    books = [[ints[k][p * dims:(p + 1) * dims] for k in first] for p in range(parts)]

    def assign():
        out = []
        for v in ints:
            own = []
            for p in range(parts):
                own.append(min((sum((a - b) ** 2 for a, b in zip(v[p * dims:(p + 1) * dims], e)), k)
                               for k, e in enumerate(books[p])))
            out.append(own)
        return out
    for _ in range(rounds):
        own = assign()
        for p in range(parts):
            groups = defaultdict(list)
            for v, o in zip(ints, own):
                groups[o[p][1]].append(v[p * dims:(p + 1) * dims])
            for e, g in groups.items():
                books[p][e] = [sum(c) // len(g) for c in zip(*g)]
    own = assign()
    error = [min(sum(min(d, 2**63 - 1) for d, _ in o), 2**63 - 1) for o in own]
    by_label = defaultdict(int)
    for (_, _, lab), e in zip(kept, error):
        by_label[lab] += e
    return [(i, "".join(f"{k:02x}" for _, k in o), e, min(by_label[lab], 2**63 - 1))
            for (i, _, lab), o, e in zip(kept, own, error)], books


def same(spark, rows, **how):
    how = dict(parts=2, entries=4, rounds=3, scale=16) | how
    block = how.pop("block", 8)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows],
                               "vec_id long, embedding array<double>, label int, row string, part int").repartition(5)
    got, books = compress(df, block=block, **how)
    want, plain_books = plain(rows, **how)
    key = lambda r: (r[0] is None, r)
    assert sorted(((r["id"], r["code"], r["error"], r["label_error"]) for r in got.collect()), key=key) == sorted(want, key=key)
    assert codebooks_sha256(books) == codebooks_sha256([np.array(b, object) for b in plain_books])


def vectors(rng, n, width=6, spread=1.0):
    return [(k, [rng.gauss(0, spread) for _ in range(width)], rng.choice([0, 1, None])) for k in range(n)]


@pytest.mark.parametrize("block", [1, 8, 500])
def test_equals_plain_rounds(spark, block):
    rng = random.Random(block)
    rows = vectors(rng, 150)
    rows += [(500 + k, rows[3][1], 1) for k in range(70)]              # one vector on a third of all rows
    rows += [rows[5], rows[5], (7, [0.5] * 6, 2), (None, [0.1] * 6, 0)]    # repeated rows and ids, a null id
    rows += [(600, None, 0), (601, [0.1, None], 0), (602, [float("nan")] * 6, 0), (603, [float("-inf")] * 6, 0),
             (604, [], 0), (605, [0.25], 3)]
    same(spark, rows, block=block)


def test_grid_ties_go_to_the_lower_entry(spark):
    rows = [(k, [float(a), float(b)], k % 3) for k, (a, b) in enumerate(itertools.product(range(-4, 5), repeat=2))]
    same(spark, rows, parts=1, entries=5, scale=1)
    same(spark, rows, parts=2, entries=9, scale=1, block=3)


def test_values_beyond_64_bits_are_exact(spark):
    rng = random.Random(3)
    rows = vectors(rng, 30) + [(100 + k, [rng.choice([1e8, -3e12, 1e200, 2.0**31, 0.1]) for _ in range(6)], 5) for k in range(12)]
    same(spark, rows)


def test_fewer_rows_than_entries_and_an_empty_table(spark):
    same(spark, vectors(random.Random(1), 3), entries=16)
    df = spark.createDataFrame([(1, None, 2)], "vec_id long, embedding array<double>, label int")
    got, books = compress(df)
    assert got.collect() == [] and books == []
    assert got.columns == ["id", "label", "code", "error", "label_error"]


def test_many_labels_are_joined_without_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr("evoselect.llm.vector_codes.FEW_LABELS", 0)
    same(spark, vectors(random.Random(2), 60))


def test_floors_go_down():
    assert scaled(np.array([-0.1, 0.1, -1.0]), 16).tolist() == [-2, 1, -16]
    assert scaled(np.array([1e300, -0.1]), 16).tolist() == [int(1e300) * 16, -2]


@pytest.mark.parametrize("dims,bits", [(1, 5), (2, 4), (3, 3), (5, 2)])
def test_neighbours_on_the_curve_are_neighbours_in_space(dims, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    keys = hilbert_keys(cells, bits)
    assert sorted(keys.tolist()) == list(range(len(cells)))
    path = cells[np.argsort(keys)]
    assert (abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_shortlist_keeps_every_nearest_entry():
    rng = np.random.default_rng(0)
    for _ in range(300):
        entries = rng.integers(-9, 10, (8, 3))
        x = rng.integers(-3, 4, (5, 3)) + rng.integers(-9, 10, 3)
        listed = shortlist(x.min(0), x.max(0), entries)
        got = nearest(x, entries, listed)
        want = nearest(x, entries, np.arange(8))
        assert (got[0] == want[0]).all() and (got[1] == want[1]).all()


def test_clash_of_names(spark):
    df = spark.createDataFrame([(1, [0.5, 1.0], 1)], "vec_id long, embedding array<double>, label int") \
        .withColumn("error", F.lit("e")).withColumn("code", F.lit("c"))
    assert compress(df, parts=2)[0].first()["code"] == "0000"
