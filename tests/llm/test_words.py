import numpy as np
import pyarrow as pa
from evoselect.llm.exchange import distinct
from evoselect.llm.features import vocabulary
from evoselect.llm.words import hash_words, shingle_hashes, split_words, window_hashes
from hypothesis import given, settings
from hypothesis import strategies as st


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aé\u00a0\x1f \t\n\x0b\x0c\rZ|漢", max_size=40)), max_size=6))
def test_words_are_what_bytes_split_gives(texts):
    w = split_words(pa.array(texts, pa.string()))
    want = [(t or "").encode().split() for t in texts]
    assert w.counts.tolist() == [len(x) for x in want]
    flat = [x for y in want for x in y]
    assert [w.buf[a:b].tobytes() for a, b in zip(w.starts, w.ends)] == flat
    h = dict(zip(flat, hash_words(w).tolist()))
    assert len(set(h.values())) == len(h)
    assert all(h[x] == y for x, y in zip(flat, hash_words(w).tolist()))


def test_words_of_a_slice_and_of_long_words():
    column = pa.array(["skip", "a " + "b" * 3000, None, "b" * 3000 + " " + "b" * 2999]).slice(1)
    w = split_words(column)
    h = hash_words(w)
    assert w.counts.tolist() == [2, 0, 2]
    assert h[1] == h[2] and h[1] != h[3]


def test_window_hashes_depend_on_the_words_only():
    h = np.random.default_rng(0).integers(0, 9, 400).astype(np.uint64)
    at = np.arange(400 - 7 + 1)
    for f in (window_hashes(h, 7, at), shingle_hashes(h, 7)):
        by = {}
        for k in at:
            by.setdefault(tuple(h[k:k + 7]), set()).add(int(f[k]))
        assert all(len(v) == 1 for v in by.values())
        assert len({x for v in by.values() for x in v}) == len(by)


def test_distinct_keys_come_in_one_order_with_counts():
    h = np.random.default_rng(1).integers(0, 2**63, 50).astype(np.uint64).repeat(3)
    for low in (None, np.zeros(len(h), np.uint32)):
        k = distinct(h, 7, low)
        assert k.counts.tolist() == [3] * 50 and k.bounds[0] == 0 and k.bounds[-1] == 50
        assert (np.diff(k.bounds) >= 0).all()
        assert (k.inverse.reshape(-1, 3) == k.inverse.reshape(-1, 3)[:, :1]).all()


def test_vocabulary_lowers_latin_letters():
    v = vocabulary(pa.array(["École école ÉCOLE ×"]))
    assert len(v.keys) == 2
