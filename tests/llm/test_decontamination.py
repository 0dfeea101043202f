import random
import re
import time

import pytest
from evoselect.llm.decontamination import find_leaks, tile
from helpers import DOCS, awkward_docs
import numpy as np


def plain_tiles(a, b, least):
    """Greedy string tiling by definition: the longest free match, again and again."""
    fa, fb, out = [True] * len(a), [True] * len(b), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and fa[i + n] and fb[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return out
        fa[i:i + n] = [False] * n
        fb[j:j + n] = [False] * n
        out += n


def test_tiles_cover_what_the_definition_covers():
    rng = random.Random(0)
    for _ in range(150):
        b = [rng.randrange(1, 30) for _ in range(rng.randint(3, 40))]
        cut = rng.randrange(len(b))
        a = [rng.randrange(1, 30) for _ in range(5)] + b[cut:] + [77] + b[:cut] + [rng.randrange(1, 30) for _ in range(5)]
        got = tile(np.array(a, np.uint64), np.array(b, np.uint64), 3)
        seen_a, seen_b = set(), set()
        for i, j, n in got:
            assert n >= 3 and a[i:i + n] == b[j:j + n]
            assert not seen_a & set(range(i, i + n)) and not seen_b & set(range(j, j + n))
            seen_a |= set(range(i, i + n))
            seen_b |= set(range(j, j + n))
        assert sum(t[2] for t in got) == plain_tiles(a, b, 3)


@pytest.mark.parametrize("letters,least", [(1, 5), (2, 2), (3, 1), (6, 3)])
def test_tiles_of_few_different_words(letters, least):
    rng = random.Random(letters)
    for _ in range(120):
        a, b = ([rng.randrange(1, letters + 1) for _ in range(rng.randint(0, 45))] for _ in range(2))
        got = tile(np.array(a, np.uint64), np.array(b, np.uint64), least, rng.choice([1, 4, 20]))
        assert sum(t[2] for t in got) == plain_tiles(a, b, least)


def test_one_word_again_and_again_takes_no_time():
    begin = time.monotonic()
    assert tile(np.full(20_000, 7, np.uint64), np.full(200, 7, np.uint64)) == [(0, 0, 200)]
    assert time.monotonic() - begin < 1


def words(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").lower())


@pytest.mark.parametrize("broadcast", [10**6, 0])
def test_copies_reordered_passages_and_clean_documents(spark, broadcast):
    rng = random.Random(8)
    item = [f"q{rng.randrange(10**6)}" for _ in range(40)]
    other = [f"r{rng.randrange(10**6)}" for _ in range(30)]
    rows = [r if r[0] is None else (r[0] + 1000, *r[1:]) for r in awkward_docs(1)]
    pad = " ".join(f"z{k}" for k in range(20))
    rows += [(1, f"{pad} {' '.join(item).upper()} {pad}", "en", "s", 1),
             (2, f"{' '.join(item[20:])}, {pad}; {' '.join(item[:20])}.", "en", "s", 1),     # reordered
             (3, f"{pad} {' '.join(item[:10])}", "en", "s", 1),                               # a quarter only
             (4, " ".join(x for k in range(0, 40, 4) for x in [*item[k:k + 4], "stop"]), "en", "s", 1),  # short runs
             (5, " ".join(item) + " " + " ".join(other), "en", "s", 1)]
    bench = spark.createDataFrame([(10, " ".join(item)), (11, " ".join(other)), (12, None), (13, ""), (14, "a b"),
                                   (15, " ".join(item))], "item_id long, text string")
    got = find_leaks(spark.createDataFrame(rows, DOCS), bench, broadcast_seeds=broadcast).collect()
    assert len(got) == len(rows)
    assert all((14 in [x.item_id for x in r.leaks]) == (" a b " in f" {' '.join(words(r.text))} ") for r in got)
    leaks = {r.doc_id: sorted((x.item_id, x.tiled_words, x.tiles) for x in r.leaks) for r in got
             if r.leaks and (r.doc_id or 0) < 1000}
    assert leaks == {1: [(10, 40, 1), (15, 40, 1)], 2: [(10, 40, 2), (15, 40, 2)],
                     5: [(10, 40, 1), (11, 30, 1), (15, 40, 1)]}


@pytest.mark.parametrize("broadcast", [10**6, 0])
def test_short_items_unspaced_scripts_and_order(spark, broadcast):
    docs = [(1, "so Paris, France! and more words here", "en", "s", 1), (2, "paris is not in france", "en", "s", 1),
            (3, "他说今天天气很好我们去公园玩吧然后回家", "zh", "s", 1), (4, "今天没有", "zh", "s", 1), (5, "42", "en", "s", 1),
            (6, "the quick brown fox jumps over a dog. paris france 42", "en", "s", 1), (None, "42", "en", "s", 1)]
    items = [(10, "Paris, France"), (1, "the quick brown fox jumps"), (2, "42"), (9, "今天天气很好我们去公园玩吧"), (None, "42"),
             (3, "quick brown fox jump"), (4, "!"), (2, "42")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = find_leaks(spark.createDataFrame(docs, DOCS), bench, broadcast_seeds=broadcast).collect()
    leaks = {(r.doc_id, r.text): [(x.item_id, x.tiled_words) for x in r.leaks] for r in got}
    assert {k[0]: v for k, v in leaks.items() if k[0]} == {
        1: [(10, 2)], 2: [], 3: [(9, 13)], 4: [], 5: [(None, 1), (2, 1), (2, 1)],
        6: [(None, 1), (1, 5), (2, 1), (2, 1), (10, 2)]}
    assert leaks[None, "42"] == [(None, 1), (2, 1), (2, 1)]


def test_both_paths_give_the_same_arrays(spark):
    rng = random.Random(2)
    items = [(str(k), " ".join(rng.choice("abcdefg") for _ in range(rng.choice([1, 3, 4, 7, 12, 30])))) for k in range(25)]
    docs = [(k, " ".join(rng.choice("abcdefg") for _ in range(rng.choice([0, 3, 30, 200]))), "en", "s", 1) for k in range(60)]
    bench = spark.createDataFrame(items, "item_id string, text string")
    docs = spark.createDataFrame(docs, DOCS)
    one, two = (sorted(find_leaks(docs, bench, broadcast_seeds=n).collect()) for n in (10**6, 0))
    assert one == two and any(len(r.leaks) > 9 for r in one)


def test_empty_tables(spark):
    bench = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    docs = spark.createDataFrame(awkward_docs(), DOCS)
    assert find_leaks(spark.createDataFrame([], DOCS), bench).collect() == []
    assert all(r.leaks == [] for r in find_leaks(docs, bench.where("false")).collect())
