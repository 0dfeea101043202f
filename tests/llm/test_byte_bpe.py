import random

import public_tokenizers
import pytest
import tiktoken
from evoselect.llm.byte_bpe import (
    EncodedText, Encoder, PrefixTable, Ranks, Splitter, decode, encode, load_ranks, odd_code_points)
from helpers import DOCS, awkward_docs
from pyspark.sql import functions as F

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return load_ranks(PATH)


@pytest.fixture(scope="module")
def encoder(ranks):
    return Encoder(ranks, Splitter(public_tokenizers.PATTERN, odd_code_points()))


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks.ids, special_tokens={})


def texts(rng, odd):
    for _ in range(400):
        kind = rng.choice([range(32, 127), range(0x20, 0x3000), range(0xE000, 0x110000), odd, [0x20, 0x27, 0x73, 0x6C, 0x0A, 0x85]])
        yield "".join(chr(rng.choice(kind)) for _ in range(rng.randint(0, 60)))
    for _ in range(100):
        yield "".join(rng.choice("abcdeilnorst") for _ in range(rng.randint(1, 400)))


def test_ids_are_the_librarys(encoder, library):
    rng = random.Random(0)
    for t in [*texts(rng, list(odd_code_points()) or [0x20]), "a" * 5000, " " * 900 + "x", "don't we'll", "", "\n\n \t"]:
        assert encoder.encode(t) == library.encode_ordinary(t), t


def test_joined_tokens_are_split_as_the_library_does(encoder, library, ranks):
    rng = random.Random(1)
    words = list(ranks.ids)
    for _ in range(1500):
        t = b"".join(rng.choice(words) for _ in range(rng.randint(1, 9))).decode("utf-8", "replace")
        assert encoder.encode(t) == library.encode_ordinary(t), t


def test_every_prefix_has_its_encoding(ranks):
    rng = random.Random(2)
    for _ in range(60):
        data = bytes(rng.choice(b"abcdeilnorst\xc3\xa9 ") for _ in range(rng.randint(0, 60)))
        table = PrefixTable(ranks, data)
        for k in range(len(data) + 1):
            assert table.tokens(k) == ranks.merge(data[:k])


def test_appends_and_edits_of_bytes(ranks):
    rng = random.Random(3)
    for _ in range(150):
        data = bytes(rng.choice(b"abcdeilnorst") for _ in range(rng.randint(0, 300)))
        table = PrefixTable(ranks, data)
        for _ in range(3):
            a = rng.randint(0, len(table.data))
            b = rng.randint(a, min(len(table.data), a + 9))
            table.edit(a, b, bytes(rng.choice(b"abnorst") for _ in range(rng.randint(0, 9))))
            assert table.tokens() == ranks.merge(table.data)
            table.append(b"ing")
            assert table.tokens() == ranks.merge(table.data)


def test_an_edit_is_local(ranks):
    rng = random.Random(4)
    table = PrefixTable(ranks, bytes(rng.choice(b"abcdeilnorst") for _ in range(20_000)))
    assert table.edit(5000, 5001, b"zz") < 500


def test_appends_and_edits_of_texts(encoder, library):
    rng = random.Random(5)
    for _ in range(150):
        text = EncodedText(encoder, "".join(rng.choice(["don't ", "  ", "we're", "hello ", "\n", "a1", "é½", " x"])
                                            for _ in range(rng.randint(0, 30))))
        for _ in range(4):
            a = rng.randint(0, len(text.text))
            b = rng.randint(a, min(len(text.text), a + 5))
            text.edit(a, b, rng.choice(["", "'s", " ", "zz", "\n ", "1", "'"]))
            assert text.ids() == library.encode_ordinary(text.text)
            text.append(rng.choice([" more", "s", "'", " "]))
            assert text.ids() == library.encode_ordinary(text.text)
    long = EncodedText(encoder, "some words " * 2000)
    assert long.edit(9000, 9001, "Q") < 20
    assert long.ids() == library.encode_ordinary(long.text)


def test_a_token_that_merging_never_forms():
    """``abc`` can't be merged from its bytes: it is used for a whole piece only."""
    odd = Ranks({**{bytes([k]): k for k in range(256)}, b"ab": 256, b"bcd": 257, b"abc": 258, b"cd": 259})
    library = tiktoken.Encoding("odd", pat_str=r"\S+|\s+", mergeable_ranks=odd.ids, special_tokens={})
    own = Encoder(odd, Splitter(r"\S+|\s+", {}))
    rng = random.Random(6)
    for t in ["abc", "abcd", "bcd", "abcabc", *("".join(rng.choice("abcd") for _ in range(rng.randint(1, 12))) for _ in range(300))]:
        assert own.encode(t) == library.encode_ordinary(t), t


def test_tables(spark, library):
    rows = awkward_docs() + [(300, "é 漢字 \U00030000 𝄞", "en", "s", 1)]
    df = spark.createDataFrame(rows, DOCS).withColumn("ids", F.lit("clash")).withColumn("decoded", F.lit("clash"))
    got = decode(encode(df, PATH, public_tokenizers.PATTERN), PATH).select("doc_id", "text", "ids", "decoded", "lang").collect()

    def key(r):
        return [(x is None, x) for x in r]
    want = [(r[0], r[1], library.encode_ordinary(r[1] or ""), (r[1] or "").encode(), r[2]) for r in rows]
    assert sorted(((r[0], r[1], r[2], bytes(r[3]), r[4]) for r in got), key=key) == sorted(want, key=key)
    assert decode(encode(df.limit(0), PATH, public_tokenizers.PATTERN), PATH).collect() == []
    some = spark.createDataFrame([(None,), ([],), ([65, 66],)], "ids array<int>")
    assert [bytes(r.decoded) for r in decode(some, PATH).collect()] == [b"", b"", b"".join(load_ranks(PATH).words[i] for i in (65, 66))]


def test_bytes_that_are_not_utf8(spark, library):
    df = spark.range(1).selectExpr("id AS doc_id", "CAST(unhex('61FF62') AS STRING) AS text")
    assert encode(df, PATH, public_tokenizers.PATTERN).first()["ids"] == library.encode_ordinary("a�b")
