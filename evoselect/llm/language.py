"""Language identification of mixed text (operator 3).

1. *Script ranges.*  The first letter of a word has a script; only languages
   that use this script in training text stay candidates for the word (all
   languages, if none uses it).
2. *Per-word scores.*  A word's score in a language is the mean log-probability
   of its byte n-grams (sizes 1 to 4 and 6, with borders) times the word's
   weight.  Words without a letter score the same everywhere.
3. *Viterbi.*  The best sequence of languages over all words of the text, where
   every switch costs ``SWITCH``, labels the spans.
4. The text's language is the one whose spans hold the most letter words; the
   score is its share of them.

The model is fitted on at most ``MOST_ROWS`` labelled documents of the training
folds, chosen by a hash of the id; the same number from each language as far
as they go.  Whole texts are labelled: words are cut into steps of ``STEP``,
every step's best path from each language to each other is found for all steps
of a batch at once, and the steps are chained, so a text of any length costs a
few numpy operations a step.

A null text, and one without a letter, is ``und`` with score 0.  Null
languages are never trained on.  Without training rows every text is ``und``.
Repeated rows and null ids are labelled like others; null ids are never
trained on.  Ties go to the language first in alphabetical order.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .features import Vocabulary, bins, byte_ngrams, fold, vocabulary
from .packing import slices

MOST_ROWS = 6_000
BITS = 17
SIZES = (1, 2, 3, 4, 6)
SWITCH = 4.0
STEP = 64
BLOCK_BYTES = 32 << 20
UNDETERMINED = "und"
#: a script belongs to a language from this share of its letter words on
SCRIPT_SHARE = 0.001

# First code points of ranges, and the number of the script whose
# letters lie there (7: any other), up to the next row's.
_RANGES = (
    (0x0000, 1), (0x0370, 2), (0x0400, 3), (0x0530, 4), (0x0590, 5), (0x0600, 6), (0x0700, 7), (0x0750, 6),
    (0x0780, 7), (0x0870, 6), (0x0900, 8), (0x0980, 9), (0x0A00, 10), (0x0A80, 11), (0x0B00, 12), (0x0B80, 13),
    (0x0C00, 14), (0x0C80, 15), (0x0D00, 16), (0x0D80, 17), (0x0E00, 18), (0x0E80, 19), (0x0F00, 20), (0x1000, 21),
    (0x10A0, 22), (0x1100, 23), (0x1200, 24), (0x13A0, 7), (0x1C80, 3), (0x1C90, 22), (0x1CC0, 7), (0x1D00, 1),
    (0x1F00, 2), (0x2000, 1), (0x2C00, 7), (0x2C60, 1), (0x2C80, 7), (0x2D00, 22), (0x2D30, 7), (0x2D80, 24),
    (0x2DE0, 3), (0x2E00, 7), (0x2E80, 26), (0x3031, 25), (0x3036, 26), (0x3040, 25), (0x3100, 7), (0x3130, 23),
    (0x3190, 26), (0x31A0, 7), (0x31F0, 25), (0x3200, 26), (0xA000, 7), (0xA640, 3), (0xA6A0, 7), (0xA720, 1),
    (0xA800, 7), (0xA8E0, 8), (0xA900, 7), (0xA960, 23), (0xA980, 7), (0xAB00, 24), (0xAB30, 1), (0xAB70, 7),
    (0xAC00, 23), (0xD800, 7), (0xF900, 26), (0xFB00, 1), (0xFB13, 4), (0xFB1D, 5), (0xFB50, 6), (0xFF00, 1),
    (0xFF66, 25), (0xFFA0, 23), (0xFFE0, 7), (0x1AFF0, 25), (0x1B170, 7), (0x1EE00, 6), (0x1EF00, 7), (0x20000, 26),
    (0x323B0, 7),
)
SCRIPTS = 27
_POINTS = 0x110000


@lru_cache(maxsize=1)
def letter_scripts() -> np.ndarray:
    """Script of every code point that is a letter (Unicode category L), else 0."""
    out = np.zeros(_POINTS, np.uint8)
    stops = [a for a, _ in _RANGES[1:]] + [_POINTS]
    for (start, script), stop in zip(_RANGES, stops):
        out[start:stop] = script
    letter = np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(_POINTS)), bool, _POINTS)
    return np.where(letter, out, 0).astype(np.uint8)


@dataclass
class Model:
    languages: list[str]
    logp: np.ndarray      # bins x languages
    allowed: np.ndarray   # scripts x languages
    bits: int


def word_scripts(v: Vocabulary) -> np.ndarray:
    """Script of the first letter of each distinct word; 0 if it has none."""
    size = v.ends - v.starts
    out = np.zeros(len(size), np.int64)
    owner = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(owner)) + np.repeat(v.starts - (np.cumsum(size) - size), size)
    lead = (v.words.buf[at] & 0xC0) != 0x80
    owner, at = owner[lead], at[lead]
    buf = np.concatenate([v.words.buf, np.zeros(4, np.uint8)]).astype(np.int32)
    a = buf[at]
    b, c, d = (buf[at + k] & 0x3F for k in (1, 2, 3))
    point = np.select([a < 0x80, a < 0xE0, a < 0xF0],
                      [a, (a & 0x1F) << 6 | b, (a & 0x0F) << 12 | b << 6 | c],
                      (a & 0x07) << 18 | b << 12 | c << 6 | d)
    script = letter_scripts()[np.minimum(point, _POINTS - 1)]
    letter = np.flatnonzero(script)
    words, first = np.unique(owner[letter], return_index=True)
    out[words] = script[letter[first]]
    return out


def viterbi(emit: np.ndarray, first: np.ndarray, switch: float, step: int = STEP,
            which: np.ndarray | None = None, block_bytes: int = BLOCK_BYTES) -> np.ndarray:
    """Best state of every word, text by text (``first``: where each begins),
    when a change of state costs ``switch``.  Word w has the scores
    ``emit[which[w]]`` (``emit[w]`` without ``which``).

    Texts are cut into steps; steps go through in blocks, earlier steps of all
    texts first, so that what a block holds (states x states numbers for a step
    that another follows) stays near ``block_bytes``."""
    n, states = int(first[-1]), emit.shape[1]
    if which is None:
        which = np.arange(n)
    label = np.zeros(n, np.int64)
    counts = np.diff(first)
    steps = -(-counts // step)
    total = int(steps.sum())
    if not total:
        return label
    of_doc = np.repeat(np.arange(len(counts)), steps)
    nth = np.arange(total) - np.repeat(np.cumsum(steps) - steps, steps)
    begin = first[of_doc] + nth * step
    size = np.minimum(counts[of_doc] - nth * step, step)
    last = nth == steps[of_doc] - 1
    longest = int(size.max())
    order = np.argsort(nth, kind="stable")

    def run(some: np.ndarray, score: np.ndarray, keep: np.ndarray | None = None) -> np.ndarray:
        """Scores after the steps ``some``, from scores at their begin (steps x ... x states)."""
        for t in range(longest):
            live = np.flatnonzero(size[some] > t)
            if not len(live):
                break
            s = score[live]
            top = s.max(-1, keepdims=True) - switch
            if keep is not None:
                keep[t, live] = np.where(s >= top, np.arange(states), s.argmax(-1)[..., None])
            e = emit[which[begin[some[live]] + t]]
            score[live] = np.maximum(s, top) + (e if s.ndim == 2 else e[:, None, :])
        return score

    # scores at the begin of every step
    enter = np.zeros((total, states))
    followed = order[~last[order]]
    each = max(1, block_bytes // (8 * states * states))
    for k in range(0, len(followed), each):
        some = followed[k:k + each]
        through = run(some, np.where(np.eye(states) > 0, 0.0, -1e18)[None].repeat(len(some), 0))
        for t in np.unique(nth[some]):
            at = np.flatnonzero(nth[some] == t)
            after = (enter[some[at]][:, :, None] + through[at]).max(1)
            enter[some[at] + 1] = after - after.max(1, keepdims=True)
    # from the last steps back: the state at the end of each, its words, the state before it
    end = np.zeros(total, np.int64)
    each = max(1, block_bytes // (8 * states * (longest + 1)))
    for stop in range(len(order), 0, -each):
        some = order[max(0, stop - each):stop]
        back = np.zeros((longest, len(some), states), np.int8 if states < 128 else np.int32)
        leave = run(some, enter[some], back)
        end[some[last[some]]] = leave.argmax(1)[last[some]]
        for level in np.unique(nth[some])[::-1]:
            at = np.flatnonzero(nth[some] == level)
            state = end[some[at]].copy()
            for t in range(longest - 1, -1, -1):
                live = np.flatnonzero(size[some[at]] > t)
                if len(live):
                    label[begin[some[at[live]]] + t] = state[live]
                    state[live] = back[t, at[live], state[live]]
            if level:
                end[some[at] - 1] = state
    return label


def _emissions(v: Vocabulary, m: Model) -> tuple[np.ndarray, np.ndarray]:
    """(scores of distinct words by language, whether they have a letter)."""
    owner, h = byte_ngrams(v, SIZES)
    script = word_scripts(v)
    n = np.bincount(owner, minlength=len(v.keys))
    f = bins(h, m.bits)
    scores = np.stack([np.bincount(owner, m.logp[f, k], len(v.keys)) for k in range(len(m.languages))], 1)
    letters = script > 0
    weight = np.log1p(v.ends - v.starts)
    scores = scores / np.maximum(n, 1)[:, None] * weight[:, None] * letters[:, None]
    allowed = m.allowed[script]
    scores[~allowed & letters[:, None]] = -1e3
    return scores, letters


def label_words(column, m: Model, switch: float = SWITCH) -> tuple[Vocabulary, np.ndarray, np.ndarray]:
    """(words, language of each, whether each has a letter)."""
    v = vocabulary(column)
    scores, letters = _emissions(v, m)
    return v, viterbi(scores, v.words.first, switch, which=v.which), letters[v.which]


def training_sample(rows: DataFrame, counts: dict[str, int], each: int, seed: int) -> DataFrame:
    """At most ``each`` rows (id, lang, text) of every language, the first by a
    hash of the id.  ``counts``: rows of each language.

    Only ids whose hash lies below a bar meet their language's others, about
    twice as many as needed; where ids that repeat leave too few, the bar rises."""
    spark, number = rows.sparkSession, F.xxhash64("id", F.lit(seed))
    shares = {lang: min(1.0, 2 * each / n) for lang, n in counts.items()}
    while True:
        bar = F.broadcast(spark.createDataFrame(list(shares.items()), "lang string, bar double"))
        low = rows.select("id", "lang").join(bar, "lang").where(number / 2.0**64 + 0.5 <= F.col("bar"))
        low = materialize(low.select("id", "lang").distinct(), "ids")
        enough = {r["lang"] for r in low.groupBy("lang").count().where(F.col("count") >= each).collect()}
        short = [lang for lang, share in shares.items() if share < 1 and lang not in enough]
        if not short:
            break
        shares |= {lang: min(1.0, 8 * shares[lang]) for lang in short}

    def first_of_each(some: DataFrame, *last) -> DataFrame:
        w = Window.partitionBy("lang").orderBy(number, "id", *last)
        return some.withColumn("_nth", F.row_number().over(w)).where(F.col("_nth") <= each).drop("_nth")

    # ids that repeat bring all their rows: the bound holds for rows too
    return first_of_each(rows.join(F.broadcast(first_of_each(low)), ["id", "lang"]), F.xxhash64("text"))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          held_out: tuple[int, int] | None = (3, 1), most_rows: int = MOST_ROWS, bits: int = BITS,
          seed: int = 5) -> Model | None:
    ident = F.col(f"`{id_col}`")
    rows = docs.where(ident.isNotNull() & F.col(f"`{lang_col}`").isNotNull() & F.col(f"`{text_col}`").isNotNull())
    if held_out is not None:
        rows = rows.where(fold(ident, held_out[0]) != held_out[1])
    rows = rows.select(ident.alias("id"), F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").alias("text"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # the label set
    languages = sorted(counts)
    if not languages:
        return None
    each = max(1, most_rows // len(languages))
    sample = materialize(training_sample(rows, counts, each, seed), "sample")
    place = {lang: k for k, lang in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = np.zeros((len(place), 1 << bits), np.float32)
        scripts = np.zeros((len(place), SCRIPTS), np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                v = vocabulary(part.column("text"))
                lang = np.array([place[x] for x in part.column("lang").to_pylist()])
                doc, word = v.per_doc()
                script = word_scripts(v)
                np.add.at(scripts, (lang[doc], script[word]), 1)
                owner, h = byte_ngrams(v, SIZES)
                f = bins(h, bits)
                for k in range(len(place)):
                    uses = np.bincount(word[lang[doc] == k], minlength=len(v.keys))
                    grams[k] += np.bincount(f, uses[owner], 1 << bits).astype(np.float32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(range(len(place)))), pa.array([x.tobytes() for x in grams]),
             pa.array([x.tobytes() for x in scripts])], ["k", "grams", "scripts"])

    grams = np.zeros((len(languages), 1 << bits))
    scripts = np.zeros((len(languages), SCRIPTS))
    for r in sample.coalesce(8).mapInArrow(count, "k long, grams binary, scripts binary").toLocalIterator():
        grams[r["k"]] += np.frombuffer(r["grams"], np.float32)
        scripts[r["k"]] += np.frombuffer(r["scripts"], np.int64)
    p = (grams + 0.1) / (grams + 0.1).sum(1, keepdims=True)
    logp = np.log(p).T
    logp -= logp.mean(1, keepdims=True)
    letters = np.maximum(1, scripts[:, 1:].sum(1, keepdims=True))
    allowed = (scripts / letters >= SCRIPT_SHARE).T
    allowed[~allowed.any(1)] = True
    return Model(languages, np.ascontiguousarray(logp), allowed, bits)


def identify(docs: DataFrame, model: Model | None, text_col: str = "text", switch: float = SWITCH) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``spans`` (first word, words,
    language of each span of one language).  Columns of these names are
    replaced."""
    docs = docs.drop("lang_pred", "score", "spans")
    kind = "array<struct<first:int,words:int,lang:string>>"
    if model is None:
        return docs.select("*", F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"),
                           F.array().cast(kind).alias("spans"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**bits numbers for each language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = pa.array([*m.languages, UNDETERMINED])
        for batch in batches:
            for part in slices(batch, "_text"):
                v, label, letters = label_words(part.column("_text"), m, switch)
                n, doc = part.num_rows, v.words.doc()
                held = np.bincount((doc * len(m.languages) + label)[letters], minlength=n * len(m.languages)) \
                    .reshape(n, -1)
                total = held.sum(1)
                best = np.where(total > 0, held.argmax(1), len(m.languages))
                score = np.where(total > 0, held.max(1) / np.maximum(total, 1), 0.0)
                new = np.ones(len(label), bool)
                new[1:] = (label[1:] != label[:-1]) | (doc[1:] != doc[:-1])
                at = np.flatnonzero(new)
                spans = pa.StructArray.from_arrays(
                    [pa.array(at - v.words.first[doc[at]], pa.int32()),
                     pa.array(np.diff(np.append(at, len(label))), pa.int32()), names.take(pa.array(label[at]))],
                    ["first", "words", "lang"])
                spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(at, v.words.first), pa.int32()), spans)
                yield pa.RecordBatch.from_arrays(
                    [part.column("_row"), names.take(pa.array(best)), pa.array(score), spans],
                    ["_row", "lang_pred", "score", "spans"])

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
                       F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"))
    schema = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
                         F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"),
                         F.array().cast(kind).alias("spans")).schema
    return rows.mapInArrow(run, schema) \
        .select(*[F.col("_row").getField(c).alias(c) for c in docs.columns], "lang_pred", "score", "spans")


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    """One row per document: its fold, predicted language and score."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.select("doc_id", "text", "lang"))
    keep = docs.select("doc_id", "text",
                       F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"))
    return identify(keep, model).select("doc_id", "held_out", "lang_pred", "score")
