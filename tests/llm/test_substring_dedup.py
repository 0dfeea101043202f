import pytest
from evoselect.llm.substring_dedup import difference_cover, remove_repeats
from helpers import DOCS, awkward_docs, repeats_removed


@pytest.mark.parametrize("period", [1, 2, 5, 7, 13, 21])
def test_cover_holds_every_difference(period):
    c = difference_cover(period)
    assert {(a - b) % period for a in c for b in c} == set(range(period))


@pytest.mark.parametrize("width,period", [(35, 21), (6, 3), (9, 7)])
def test_equals_brute_force(spark, width, period):
    rows = awkward_docs()
    docs = spark.createDataFrame(rows, DOCS)
    got = remove_repeats(docs, width=width, period=period, chunk_bytes=4000).collect()
    want = repeats_removed([r[1] for r in rows], width)
    key = lambda x: tuple(map(str, x))
    assert sorted(((r.doc_id, r.lang, r.n_words, r.n_removed, r.text) for r in got), key=key) == sorted(
        ((r[0], r[2], n, k, None if r[1] is None else t.decode()) for r, (n, k, t) in zip(rows, want)), key=key)


def test_same_document_and_overlapping_windows(spark):
    docs = spark.createDataFrame([(1, "a b a b a b c")], "doc_id long, text string")
    (r,) = remove_repeats(docs, width=4, period=3).collect()
    assert (r.n_words, r.n_removed, r.text) == (7, 6, "c")


def test_empty_table_and_clashing_columns(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert remove_repeats(docs).collect() == []
    docs = spark.createDataFrame([(1, "x y", 5, 6, 7)], "doc_id long, text string, n_words int, _chunk int, bucket int")
    (r,) = remove_repeats(docs).collect()
    assert (r.n_words, r.n_removed, r["_chunk"], r.bucket, r.text) == (2, 0, 6, 7, "x y")
