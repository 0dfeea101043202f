import collections
import functools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from evoselect.llm.packing import (
    _best_fit, best_configuration, pack_documents, pack_histogram, plan_histogram, solve_configurations)
from helpers import DOCS, awkward_docs
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_round_trip_of_awkward_documents(spark):
    rows = awkward_docs(2) + [(200, "it's  We'LL \u00a0 <|endoftext|> \0 ｆｕｌｌ e\u0301té 漢字 1234 !!??", "en", "s", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    cap = 64
    got = pack_documents(docs, PATH, capacity=cap, with_ids=True).collect()
    tok = Tokenizer.from_file(PATH)
    want = collections.Counter()
    total = 0
    for r in rows:
        ids = tok.encode(r[1] or "", add_special_tokens=False).ids + [1]
        total += len(ids)
        for k, s in enumerate(range(0, len(ids), cap)):
            part = ids[s:s + cap]
            want[r[0], k, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), tuple(part)] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, tuple(r.ids)) for r in got) == want
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= cap
    assert len(by) <= -(-total // cap) + 2


def test_knapsack_equals_enumeration():
    rng = random.Random(1)
    for _ in range(20):
        cap = rng.randint(5, 14)
        price = np.full(cap + 1, -np.inf)
        for length in rng.sample(range(1, cap + 1), min(4, cap)):
            price[length] = rng.random() * length

        def best(room):
            return max([0.0] + [price[x] + best(room - x) for x in range(1, room + 1) if price[x] > 0])
        config = best_configuration(price, cap)
        assert sum(k * n for k, n in config.items()) <= cap
        assert sum(price[k] * n for k, n in config.items()) == pytest.approx(best(cap))


def test_histograms_are_packed_whole_and_tight():
    rng = np.random.default_rng(3)
    for _ in range(5):
        demand = np.zeros(65, np.int64)
        demand[1:] = rng.integers(0, 30, 64) * (rng.random(64) < 0.5)
        used = np.zeros(65, np.int64)
        n = 0
        for config, times in pack_histogram(demand, 64, 60):
            assert times > 0 and sum(k * c for k, c in config.items()) <= 64
            n += times
            for k, c in config.items():
                used[k] += c * times
        assert (used == demand).all()
        big = demand[33:].sum()
        assert n <= max(-(-int((demand * np.arange(65)).sum()) // 64), big) * 1.1 + 2


def fewest(pieces, cap):
    """The least number of sequences, by trying every way (small cases)."""
    pieces = tuple(sorted(pieces, reverse=True))

    @functools.lru_cache(None)
    def can(left, rooms):
        if not left:
            return True
        x, rest = left[0], left[1:]
        return any(can(rest, tuple(sorted((*rooms[:k], r - x, *rooms[k + 1:])))) for k, r in enumerate(rooms)
                   if r >= x and (k == 0 or rooms[k - 1] != r))
    n = -(-sum(pieces) // cap)
    while not can(pieces, (cap,) * n):
        n += 1
    return n


def test_small_histograms_need_the_optimum():
    rng = random.Random(4)
    over = 0
    for _ in range(40):
        cap = rng.randint(20, 40)
        pieces = [rng.randint(cap // 5, cap - 1) for _ in range(rng.randint(1, 12))]
        demand = np.bincount(pieces, minlength=cap + 1)
        plan, figures = plan_histogram(demand, cap)
        best = fewest(pieces, cap)
        assert figures["bound"] <= best + 1e-6
        assert sum(n for _, n in plan) == figures["sequences"]
        over += figures["sequences"] - best
    assert over <= 1


def test_the_program_beats_best_fit():
    """Two of its sequences in three hold three lengths, and none is full."""
    demand = np.zeros(4097, np.int64)
    demand[[1366, 2000, 2100, 700]] = 300, 300, 300, 200
    plan, figures = plan_histogram(demand)
    assert figures["sequences"] == sum(n for _, n in plan) == 484
    assert 483 < figures["bound"] <= figures["value"] <= 484 + 1e-9 and figures["placed"] > 0.9
    assert sum(n for _, n in _best_fit(demand, 4096, {})) == 490


def test_the_fractional_solution_covers_everything():
    cap = 64
    rng = np.random.default_rng(5)
    for _ in range(5):
        demand = np.zeros(cap + 1, np.int64)
        demand[rng.choice(np.arange(1, cap), 6, replace=False)] = rng.integers(1, 50, 6)
        program = solve_configurations(demand, cap)
        got = np.zeros(cap + 1)
        for config, n in program.uses.items():
            assert sum(x * k for x, k in config) <= cap and n >= 0
            for x, k in config:
                got[x] += n * k
        assert (got >= demand - 1e-6).all()
        assert sum(program.uses.values()) == pytest.approx(program.value)
        assert program.bound >= demand @ np.arange(cap + 1) / cap - 1e-6
        assert program.value <= max(1.005 * program.bound, np.ceil(program.bound)) + 1e-9


def test_prices_by_size_fill_a_sequence():
    price = np.arange(65) / 64
    assert sum(k * n for k, n in best_configuration(price, 64).items()) == 64


def test_empty_table(spark):
    assert pack_documents(spark.createDataFrame([], DOCS), PATH).collect() == []
