import random

from evoselect.llm.components import connected_components
from evoselect.llm.jaccard_join import near_duplicates
from helpers import DOCS, awkward_docs, components, shingles


def check(spark, rows, **how):
    docs = spark.createDataFrame(rows, DOCS)
    got = near_duplicates(docs, **how).collect()
    sets = {}
    for r in rows:
        sets.setdefault(r[0] if r[0] is not None else 10**9, shingles(r[1]))
    want = components(sets)
    assert len(got) == len(rows)
    for r in got:
        k = r.doc_id if r.doc_id is not None else 10**9
        assert r.n_shingles == len(sets[k])
        assert (r.component_id if r.component_id is not None else 10**9) == (want[k] if sets[k] else k)
    full = [r for r in got if r.n_shingles]
    keep = [r.component_id for r in full if r.keeper]
    assert sorted(map(str, keep)) == sorted({str(r.component_id) for r in full})
    assert all(r.keeper for r in got if not r.n_shingles)


def test_awkward_documents(spark):
    check(spark, awkward_docs(3, 90), chunk_bytes=4000)


def test_chains_of_copies_that_drift(spark):
    """Each text links with its neighbours only, so leaders alone don't join all."""
    rng = random.Random(5)
    text = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for k in range(40):
        rows.append((k, " ".join(text), "en", "s", 1))
        text = text[2:] + [f"w{rng.randrange(10**6)}" for _ in range(2)]
    rng.shuffle(rows)
    check(spark, rows, fragments=3)


def test_a_common_passage_links_nothing(spark):
    rng = random.Random(6)
    passage = " ".join(f"p{k}" for k in range(12))
    rows = [(k, passage + " " + " ".join(f"u{rng.randrange(10**7)}" for _ in range(9)), "en", "s", 1) for k in range(40)]
    check(spark, rows)


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], DOCS)).collect() == []


def test_components_of_paths_and_stars(spark):
    links = [(k, k + 1) for k in range(30)] + [(100, 100 + k) for k in range(1, 20)] + [(7, 7), (300, 200), (200, 300)]
    got = dict(connected_components(spark.createDataFrame(links, "x long, y long")).collect())
    assert all(got[k] == 0 for k in range(31)) and all(got[100 + k] == 100 for k in range(20))
    assert got[300] == got[200] == 200
    assert connected_components(spark.createDataFrame([], "x long, y long")).collect() == []


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c", 7, 8, 9)], "doc_id long, text string, keeper int, n int, _chunk int")
    (r,) = near_duplicates(docs, carry=docs.columns).collect()
    assert (r.doc_id, r.text, r.keeper, r.n, r["_chunk"], r.n_shingles, r.component_id) == (1, "a b c", True, 8, 9, 1, 1)
