"""Each stage against a plain version, on the documents the stage before kept."""

import collections
import zlib

import corpus_pipeline as pipeline
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from evoselect.llm.toxicity import THRESHOLD, score_toxicity, train
from evoselect.session import materialize
from helpers import DOCS, awkward_docs, components, repeats_removed, shingles
from test_decontamination import plain_tiles, words

SF = "/root/testdata/sf0.001"


def stages(spark, docs, sf_dir):
    out = [docs]
    for name, stage in pipeline.STAGES:
        out.append(materialize(stage(spark, out[-1], sf_dir), name))
    return out


def leak_free(rows, items):
    """The rows into which no item leaks, by plain tiling of every pair that
    shares five neighbouring words (others have no tile)."""
    def seeds(w):
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}
    bench = [(w, seeds(w)) for w in (words(x.text) for x in items) if w]
    out = []
    for r in rows:
        w = words(r.text)
        s = seeds(w)
        if not any(t & s and plain_tiles(w, b, 5) >= 0.6 * len(b) - 1e-9 for b, t in bench):
            out.append(r)
    return sorted((str(r.doc_id), str(r.text)) for r in out)


def check_packed(rows, packed, capacity=4096):
    """``packed`` holds every piece of the plainly tokenised rows once, and a
    sequence's pieces follow each other without gaps."""
    tok = Tokenizer.from_file(public_tokenizers.path(pipeline.TOKENIZER))
    want = collections.Counter()
    for r in rows:
        ids = tok.encode(r.text or "", add_special_tokens=False).ids + [1]
        for k, s in enumerate(range(0, len(ids), capacity)):
            part = ids[s:s + capacity]
            want[r.doc_id, k, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == want
    by = collections.defaultdict(list)
    for r in packed:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity


def check(spark, docs, sf_dir):
    raw, clean, single, cut, free, packed = stages(spark, docs, sf_dir)
    assert all(x.columns == raw.columns for x in (clean, single, cut, free))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score_toxicity(raw, train(raw, labels.select("doc_id", "toxic")))
    assert sorted(map(str, clean.collect())) == sorted(map(str, scored.where(f"score < {THRESHOLD}").drop("score").collect()))
    rows = clean.collect()
    sets = dict(enumerate(shingles(r.text) for r in rows))
    comp = components(sets)
    kept = single.collect()
    groups = {comp[k] for k in sets if sets[k]}
    assert len(kept) == len(groups) + sum(not s for s in sets.values())
    of = {}
    for k, r in enumerate(rows):
        of.setdefault((str(r.doc_id), r.text), comp[k])
    assert len({of[str(r.doc_id), r.text] for r in kept if shingles(r.text)}) == len(groups)
    want = repeats_removed([r.text for r in kept], 35)
    texts = sorted((str(r.doc_id), None if r.text is None else w[2].decode()) for r, w in zip(kept, want))
    after = cut.collect()
    assert sorted((str(r.doc_id), r.text) for r in after) == texts
    assert all(r.n_chars == len(r.text) for r in after if r.text is not None)
    left = {str(r.doc_id) for r in free.collect()}
    assert left <= {str(r.doc_id) for r in after}
    assert {str(r.doc_id) for r in packed.collect()} == left
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in free.collect()) == leak_free(after, items)
    check_packed(free.collect(), packed.collect())


def test_given_documents(spark):
    check(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)


def test_awkward_documents(spark):
    check(spark, spark.createDataFrame(awkward_docs(), DOCS), SF)


def test_empty_table(spark):
    assert [x.count() for x in stages(spark, spark.createDataFrame([], DOCS), SF)] == [0] * 6


def test_documents_with_planted_items(spark):
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    rows = awkward_docs(3) + [(500 + k, f"before it {x.text} and after it", "en", "s", 1) for k, x in enumerate(items[:20])]
    rows += [(600 + k, " ".join(x.text.split()[:6]), "en", "s", 1) for k, x in enumerate(items[:20])]
    docs = spark.createDataFrame(rows, DOCS)
    free = pipeline.drop_contaminated(spark, docs, SF).collect()
    got = sorted((str(r.doc_id), str(r.text)) for r in free)
    assert got == leak_free(docs.collect(), items)
    assert 0 < len(got) <= len(rows) - 20
    check_packed(free, pipeline.pack_sequences(spark, spark.createDataFrame(free, DOCS), SF).collect())


def test_contract():
    assert 4 <= len(pipeline.STAGES) <= 5 and pipeline.ORACLE_SQL is None
    import __spark_entry__ as entry
    assert entry.queries()["pipeline"] is pipeline.run
    assert {f"op{n}" for n in range(1, 11)} <= {q.split("_")[0] for q in entry.queries()}


@pytest.mark.parametrize("name", ["op4_va_search", "op9_chat_format"])
def test_sql_agrees(spark, name):
    from evoselect.llm.queries import ORACLE, QUERIES
    from oracle_compare import compare, duck
    ok, message = compare(spark, duck(SF), name, QUERIES[name], ORACLE[name], SF)
    assert ok, message
