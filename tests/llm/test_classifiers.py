import random
import tracemalloc
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from evoselect.llm import language, quality, toxicity
from evoselect.llm.features import fold
from helpers import DOCS, awkward_docs
from pyspark.sql import functions as F

LABELS = "doc_id long, quality int, toxic int"


def corpus(n=500, seed=0):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(150)]
    docs, labels = [], []
    for k in range(n):
        w = [rng.choice(vocab) for _ in range(rng.randint(15, 60))]
        toxic, junk = k % 4 == 0, k % 5 == 1
        if toxic:
            w[rng.randrange(len(w))] = rng.choice(["vilezzt", "vilezzor"])
        text = " | ".join(w) if junk else " ".join(w) + "."
        docs.append((k, text, "en", "s", len(text)))
        labels.append((k, int(not junk), int(toxic)))
    return docs, labels


@pytest.mark.parametrize("which", ["toxic", "quality"])
def test_held_out_accuracy_and_awkward_rows(spark, which):
    docs, labels = corpus()
    odd = [(None if r[0] is None else r[0] + 10_000, *r[1:]) for r in awkward_docs()]
    table = spark.createDataFrame(docs + odd, DOCS).withColumn("_text", F.lit("clash")).withColumn("score", F.lit(9))
    marks = spark.createDataFrame(labels + [(3, None, None), (None, 1, 1), labels[8]], LABELS)
    m, folds, out = (toxicity, 3, 1) if which == "toxic" else (quality, 5, 0)
    model = m.train(table, marks)
    got = (m.score_toxicity if which == "toxic" else m.score_quality)(table, model)
    rows = got.withColumn("out", fold(F.col("doc_id"), folds) == out).collect()
    assert len(rows) == len(docs) + len(odd)
    assert all(0 <= r.score <= 1 and r["_text"] == "clash" for r in rows)
    cut = toxicity.THRESHOLD if which == "toxic" else quality.THRESHOLD
    truth = {i: (t if which == "toxic" else q) for i, q, t in labels}
    told = [(r.score >= cut) == bool(truth[r.doc_id]) for r in rows if r.doc_id in truth and r.out]
    assert np.mean(told) > 0.95 and len(told) > 50


def test_no_labels_and_empty_tables(spark):
    none = spark.createDataFrame([], LABELS)
    docs = spark.createDataFrame(awkward_docs(), DOCS)
    assert toxicity.train(docs, none) is None
    assert {r.score for r in toxicity.score_toxicity(docs, None).collect()} == {0.0}
    assert quality.train(docs, none) == 0.0
    assert {r.score for r in quality.score_quality(docs, 0.25).collect()} == {0.25}
    one = spark.createDataFrame([(1, 1, 0)], LABELS)
    assert quality.train(docs, one) == 1.0
    assert language.train(docs.where("lang = 'none'")) is None
    assert {r.lang_pred for r in language.identify(docs, None).collect()} == {"und"}
    assert toxicity.train(spark.createDataFrame([], DOCS), spark.createDataFrame([(1, 1, 1)], LABELS)) is None


def test_factorisation_machine_identity():
    rng = np.random.default_rng(2)
    m = quality.Model(0.3, rng.normal(size=12), rng.normal(size=(12, 3)), np.zeros(2), np.ones(2), 3)
    feature, value, begin = np.array([1, 4, 7, 2, 2, 9]), rng.normal(size=6), np.array([0, 3, 3, 6])
    z = quality._score(m, feature, value, begin)[0]
    for k in range(3):
        f, x = feature[begin[k]:begin[k + 1]], value[begin[k]:begin[k + 1]]
        want = m.w0 + (m.w[f] * x).sum() + sum(m.v[f[i]] @ m.v[f[j]] * x[i] * x[j]
                                               for i in range(len(f)) for j in range(i))
        assert z[k] == pytest.approx(want)


def test_viterbi_equals_plain_recursion():
    rng = np.random.default_rng(0)
    for _ in range(60):
        first = np.concatenate([[0], np.cumsum(rng.integers(0, 30, rng.integers(1, 6)))])
        e = rng.normal(size=(first[-1], int(rng.integers(1, 5))))
        cost = float(rng.uniform(0, 3))
        label = language.viterbi(e, first, cost, int(rng.integers(1, 8)))
        for a, b in zip(first, first[1:]):
            if a < b:
                best = e[a].copy()
                for t in range(a + 1, b):
                    best = np.maximum(best, best.max() - cost) + e[t]
                mine = e[np.arange(a, b), label[a:b]].sum() - cost * (label[a + 1:b] != label[a:b - 1]).sum()
                assert mine == pytest.approx(best.max())


def test_viterbi_in_blocks_of_one_step():
    rng = np.random.default_rng(3)
    first = np.array([0, 0, 7, 40, 41, 90])
    e, which = rng.normal(size=(12, 5)), rng.integers(0, 12, 90)
    want = language.viterbi(e[which], first, 1.5, 6)
    assert (language.viterbi(e, first, 1.5, 6, which, block_bytes=1) == want).all()


def test_every_letter_and_no_other_code_point():
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    letter = np.array([unicodedata.category(chr(c)).startswith("L") for c in points])
    chars = [chr(c) for c in points if chr(c) not in " \t\n\v\f\r"]
    letter = letter[[c not in (9, 10, 11, 12, 13, 32) for c in points]]
    v = language.vocabulary(pa.array(["7" + c + "." for c in chars]))
    assert ((language.word_scripts(v)[v.which] > 0) == letter).all()


def test_texts_without_letters_are_undetermined(spark):
    rows = [(k, t, lang, "s", 1) for k in range(30)
            for t, lang in (("سلام دنیا", "ar"), ("नमस्ते दुनिया", "hi"), ("สวัสดี ชาวโลก", "th"), ("hello world", "en"))]
    docs = spark.createDataFrame(rows, DOCS)
    asked = spark.createDataFrame([(k, t, None, "s", 1) for k, t in enumerate(
        ["٣٤٥ ١٢٣", "؟ ،", "१२३ ।", "๑๒๓", "๐ ฿", "123 456", "½ ² €", "٣٤٥ سلام", "々", "ʰ"])], DOCS)
    got = {r.doc_id: r for r in language.identify(asked, language.train(docs)).collect()}
    assert [(got[k].lang_pred, got[k].score) for k in range(7)] == [("und", 0.0)] * 7
    assert (got[7].lang_pred, got[7].score) == ("ar", 1.0)
    assert all(got[k].lang_pred != "und" for k in (8, 9))


def test_many_languages_and_short_texts():
    names = [f"l{k:03d}" for k in range(200)]
    m = language.Model(names, np.random.default_rng(1).normal(size=(1 << 8, 200)), np.ones((language.SCRIPTS, 200), bool), 8)
    texts = pa.array([f"word{k % 900} again{k % 37}" for k in range(50_000)])
    tracemalloc.start()
    _, label, letters = language.label_words(texts, m)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(label) == 100_000 and letters.all() and peak < 1 << 29


def test_sample_bound_holds_where_ids_repeat(spark):
    rows = [(3, "en", f"hello world {k}") for k in range(400)] + [(4, "fr", "salut monde")] + [(5, "en", "same")] * 50
    rows += [(k, "de", "guten tag") for k in range(100, 3000)]
    df = spark.createDataFrame(rows, "id long, lang string, text string")
    some = language.training_sample(df, {"en": 450, "fr": 1, "de": 2900}, 10, 5).collect()
    assert {x: sum(r.lang == x for r in some) for x in ("en", "fr", "de")} == {"en": 10, "fr": 1, "de": 10}
    first = df.where("lang = 'de'").orderBy(F.xxhash64("id", F.lit(5)), "id").limit(10).collect()
    assert sorted(r.id for r in some if r.lang == "de") == sorted(r.id for r in first)


def test_languages_spans_and_scripts(spark):
    rng = random.Random(4)
    sounds = {"aa": "kato mira selo", "bb": "øgt ßen üls", "ru": "дом река лес", "el": "λόγος νερό φως"}
    def text(lang, n):
        return " ".join(rng.choice(sounds[lang].split()) + rng.choice(["", "a", "e"]) for _ in range(n))
    rows = [(k, text(lang, 30), lang, "s", 1) for k, lang in enumerate(list(sounds) * 30)]
    rows += [(900, None, "aa", "s", 1), (901, "", None, "s", 1), (902, "123 -- !", "aa", "s", 1), (None, text("ru", 5), "ru", "s", 1),
             (903, text("aa", 40) + " " + text("ru", 25), None, "s", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: r for r in language.identify(docs, language.train(docs)).collect()}
    assert all(got[r[0]].lang_pred == r[2] for r in rows[:120])
    assert [got[k].lang_pred for k in (900, 901, 902)] == ["und"] * 3 and got[902].score == 0
    mixed = got[903]
    assert mixed.lang_pred == "aa" and mixed.score == pytest.approx(40 / 65)
    assert [(s["first"], s["words"], s["lang"]) for s in mixed.spans] == [(0, 40, "aa"), (40, 25, "ru")]


def test_select_features_is_bounded():
    toxic = np.full(5000, 90)
    chosen = toxicity.select_features(toxic, 100, np.full(5000, 5), 100, 0.1, most=100)
    assert len(chosen) == 100
    assert len(toxicity.document_features(pa.array([None, "", "a a b"]), 10)[1]) == 4
