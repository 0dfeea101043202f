import hashlib
import re

import pytest
from evoselect.llm.fill_in_middle import Rates, digests, restore, transform
from helpers import DOCS, awkward_docs
from pyspark.sql import functions as F

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(doc_id, text, rates=Rates()):
    text = text or ""
    units = UNIT.findall(text)
    d = hashlib.sha256(f"{rates.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[8 * k:8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rates.transformed:
        return len(units), "plain", None, None, text
    if h[3] % 100 < rates.spm:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


ROWS = awkward_docs() + [(200 + k, t, "en", "s", 1) for k, t in enumerate(
    ["<P> here", "a <S>", "x<M>y", "<P", "S> <", "< P>", " lead", "tail \n ", "é ß 漢字 𝄞", "\x0b\x0c\r", "a\x85b c", "<", ">"] * 3)]


def key(r):
    return tuple((x is None, x) for x in r)


@pytest.mark.parametrize("rates,units,partition", [(Rates(), 4096, 1 << 25), (Rates(100, 50), 1, 500), (Rates(100, 0, 7), 3, 1 << 25)])
def test_equals_plain_version(spark, rates, units, partition):
    df = spark.createDataFrame(ROWS, DOCS).withColumn("row", F.lit("clash")).withColumn("place", F.lit(1)).repartition(3)
    got = digests(df, rates=rates, units=units, partition_bytes=partition).collect()
    want = []
    for r in ROWS:
        n, form, pc, mc, out = plain(r[0], r[1], rates)
        want.append((r[0], n, form, pc, mc, sha(out), sha(r[1] or "")))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert len({x.form for x in got}) == (3 if rates.spm else 2)


def test_outputs_can_be_read_back(spark):
    df = spark.createDataFrame(ROWS, DOCS)
    out = transform(df, rates=Rates(100, 50), units=2)
    got = restore(out).select("doc_id", "form", "output", "text").collect()
    want = [(r[0], *plain(r[0], r[1], Rates(100, 50))[1::3], r[1] or "") for r in ROWS]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_a_third_of_all_rows_with_one_id(spark):
    rows = [(1 if k % 3 == 0 else k, f"text {k} of one id", "en", "s", 1) for k in range(90)]
    got = digests(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(x.restored_sha256 for x in got) == sorted(sha(r[1]) for r in rows)


def test_empty_table(spark):
    got = digests(spark.createDataFrame([], DOCS))
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    assert got.collect() == []


def test_one_shuffle(spark):
    """The second sort has the partitioner of the first."""
    rdd = digests(spark.createDataFrame(ROWS[:20], DOCS)).rdd
    assert rdd.toDebugString().decode().count("ShuffledRDD") + rdd.toDebugString().decode().count("PartitionerAwareUnion") <= 1
