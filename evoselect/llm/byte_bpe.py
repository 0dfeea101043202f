"""Byte-level BPE encoding and decoding by prefix dynamic programming (operator 13).

A text is split by the tokenizer's pattern, and each match (piece) is encoded
on its own.  Byte-pair merging gives every prefix of a piece exactly one
encoding, so the *last token* of each prefix describes all of them: the token t
is the last one of the prefix that ends at byte i if t ends there and t may
follow the last token of the prefix before it.  Two tokens may be neighbours
when merging their joined bytes gives just these two.  A table of last tokens
(:class:`PrefixTable`) is therefore built from left to right, in time linear in
the bytes; it grows by appended bytes without looking back, and after an edit it
is recomputed from the first changed byte until it agrees with the old table over
one longest token.  :class:`EncodedText` does the same for whole texts: an edit
splits the text again from the last piece that cannot have seen it until a piece
begins where an old one began.

A piece that is itself in the rank file is that one token, as in the tiktoken
library.  A token that merging never forms is used in that case alone.

On Spark, rows are encoded where they lie: no shuffle.  A worker remembers the
ids of at most ``REMEMBERED`` distinct pieces.  Only the path of the rank file
travels; each worker reads it once (a fixed vocabulary, no corpus data).

Null text counts as empty, and an empty text has no ids.  Null ids decode to
no bytes.  Bytes of a text that are not UTF-8 count as U+FFFD.  All columns of
the input are kept; one named like the new column is replaced.  Ids that the
vocabulary lacks are refused by ``decode``.  Rows don't depend on each other, so
repeated rows and empty tables need no rule.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from .packing import slices

#: distinct pieces whose ids a worker remembers at least (twice as many at most),
#: and the longest of them
REMEMBERED, REMEMBERED_CHARS = 250_000, 64
#: pairs of tokens whose verdict a worker remembers
PAIRS = 2_000_000
BITS = 32
_NEVER = 1 << 62
#: code points after a piece's end that can decide where it ends
AHEAD = 2

#: stand-ins, as code points: a letter, a number, white space, anything else
_STAND_INS = {"L": 0x3BB, "N": 0xBD, "s": 0x2003, "": 0xBF}


class Ranks:
    """A rank file: bytes of every id, and which tokens may be neighbours."""

    def __init__(self, ids: dict[bytes, int]):
        self.ids = ids
        top = max(ids.values())
        self.words: dict[int, bytes] = {i: w for w, i in ids.items()}
        self.longest = max(map(len, ids))
        #: ``a << BITS | b`` to the verdict on the pair
        self.pairs: dict[int, bool] = {}
        self.sizes = [len(self.words.get(i, b"")) for i in range(top + 1)]
        # what a token is merged from, where merging forms it
        self._parts: dict[int, tuple[int, int]] = {}
        #: finds all tokens that merging can form, by their bytes (as Latin-1)
        self.ends = ahocorasick.Automaton()
        for word, i in ids.items():
            *before, now = self._merged(word)
            if now == [i]:
                if before:
                    self._parts[i] = tuple(before[-1])
                self.ends.add_word(word.decode("latin-1"), i)
        self.ends.make_automaton()
        self._right = self._edges(1)
        self._left = self._edges(0)

    def _merged(self, data: bytes) -> list[list[int]]:
        """Byte-pair merging as it is defined, step by step, for a few bytes:
        the lowest rank first, the leftmost of equal ones."""
        parts = [data[k:k + 1] for k in range(len(data))]
        steps = [[self.ids[p] for p in parts]]
        while len(parts) > 1:
            ranks = [self.ids.get(a + b, -1) for a, b in zip(parts, parts[1:])]
            best = min((r for r in ranks if r >= 0), default=None)
            if best is None:
                break
            k = ranks.index(best)
            parts[k:k + 2] = [parts[k] + parts[k + 1]]
            steps.append([*steps[-1][:k], best, *steps[-1][k + 2:]])
        return steps

    def merge(self, data: bytes) -> list[int]:
        return self._merged(data)[-1]

    def _edges(self, side: int) -> dict[int, list[tuple[int, int]]]:
        """For each token the parts that lie on its left (0) or right (1) edge
        while it is merged, each with the rank of the merge that takes it in;
        the token itself comes last, and nothing takes it in."""
        out: dict[int, list[tuple[int, int]]] = {}
        for i in sorted(self.words, key=lambda i: len(self.words[i])):
            parts = self._parts.get(i)
            out[i] = [*[(p, min(r, i)) for p, r in out[parts[side]]], (i, _NEVER)] if parts else [(i, _NEVER)]
        return out

    def judge(self, a: int, b: int) -> bool:
        """May ``b`` follow ``a``?  Both are merged side by side, in the order
        of ranks; they may if no part on the right edge of ``a`` and part on the
        left edge of ``b`` that exist at one time are merged first.  Of equal
        ranks the leftmost merge comes first."""
        left, right = self._right[a], self._left[b]
        j = k = 0
        while True:
            (x, x_until), (y, y_until) = left[j], right[k]
            joined = self.ids.get(self.words[x] + self.words[y])
            if joined is not None and joined < x_until and joined <= y_until:
                verdict = False
                break
            if x_until == y_until == _NEVER:
                verdict = True
                break
            if x_until <= y_until:
                j += 1
            else:
                k += 1
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        self.pairs[a << BITS | b] = verdict
        return verdict


class PrefixTable:
    """The last token of every prefix of ``data``; -1 for the empty one."""

    def __init__(self, ranks: Ranks, data: bytes = b""):
        self.ranks, self.data, self.last = ranks, data, [-1]
        self._extend()

    def _extend(self, enough=None) -> None:
        """Find the last token of every prefix that has none yet, until
        ``enough`` says so."""
        last, ranks = self.last, self.ranks
        pairs, sizes = ranks.pairs, ranks.sizes
        need = len(last)
        skip = max(0, need - ranks.longest)
        # tokens by their end, the longest of an end first
        for end, token in ranks.ends.iter(self.data[skip:].decode("latin-1")):
            stop = skip + end + 1
            if stop < need:
                continue
            before = last[stop - sizes[token]]
            if before >= 0:
                fits = pairs.get(before << BITS | token)
                if not (ranks.judge(before, token) if fits is None else fits):
                    continue
            last.append(token)
            need += 1
            if enough is not None and enough(stop, token):
                return

    def append(self, more: bytes) -> None:
        """The table of ``data + more``; nothing before the end is read again
        but the bytes that a token may reach back."""
        self.data += more
        self._extend()

    def edit(self, start: int, stop: int, new: bytes) -> int:
        """The table with ``new`` instead of the bytes from ``start`` to
        ``stop``; returns how many prefixes were computed anew."""
        old, shift = self.last, len(new) - (stop - start)
        self.data = self.data[:start] + new + self.data[stop:]
        self.last = old[:start + 1]
        same = 0

        def enough(at: int, token: int) -> bool:
            # both tables agree wherever a token that ends later can begin
            nonlocal same
            same = same + 1 if at >= start + len(new) and token == old[at - shift] else 0
            return same >= self.ranks.longest
        self._extend(enough)
        done = len(self.last) - 1 - start
        self.last += old[len(self.last) - shift:]
        return done

    def tokens(self, stop: int | None = None) -> list[int]:
        """The encoding of the first ``stop`` bytes (all)."""
        at = len(self.data) if stop is None else stop
        out = []
        while at:
            out.append(self.last[at])
            at -= self.ranks.sizes[self.last[at]]
        return out[::-1]


class Splitter:
    """Pieces of a text.  ``odd`` maps the code points that the pattern
    library classes otherwise than the tokenizer's to stand-ins."""

    def __init__(self, pattern: str, odd: dict[int, int]):
        self.pattern = regex.compile(pattern)
        self.odd = odd
        points = np.array(sorted(odd), np.int64)
        runs = np.split(points, np.flatnonzero(np.diff(points) != 1) + 1)
        self.has_odd = re.compile("[" + "".join(f"\\U{r[0]:08x}-\\U{r[-1]:08x}" for r in runs) + "]") if odd else None

    def _plain(self, text: str) -> str:
        if self.has_odd is None or text.isascii() or not self.has_odd.search(text):
            return text
        return text.translate(self.odd)

    def pieces(self, text: str) -> list[str]:
        plain = self._plain(text)
        if plain is text:
            return self.pattern.findall(text)
        return [text[m.start():m.end()] for m in self.pattern.finditer(plain)]

    def spans(self, text: str, start: int = 0) -> Iterator[tuple[int, int]]:
        """(begin, end) of the pieces from ``start`` on, where a piece begins."""
        return (m.span() for m in self.pattern.finditer(self._plain(text), start))


class Encoder(dict):
    """Ids of pieces, remembered: those used since the last full round are
    kept, the ones before are forgotten."""

    def __init__(self, ranks: Ranks, splitter: Splitter):
        super().__init__()
        self.ranks, self.splitter = ranks, splitter
        self.older: dict[str, tuple[int, ...]] = {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        out = self.older.get(piece)
        if out is None:
            data = piece.encode()
            whole = self.ranks.ids.get(data)
            out = (whole,) if whole is not None else tuple(PrefixTable(self.ranks, data).tokens())
        if len(piece) <= REMEMBERED_CHARS:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[piece] = out
        return out

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.__getitem__, self.splitter.pieces(text))))


class EncodedText:
    """A text with its pieces and their ids, open to appends and edits."""

    def __init__(self, encoder: Encoder, text: str = ""):
        self.encoder, self.text = encoder, ""
        self.begins: list[int] = []
        self.found: list[tuple[int, ...]] = []
        self.append(text)

    def ids(self) -> list[int]:
        return list(chain.from_iterable(self.found))

    def append(self, more: str) -> int:
        return self.edit(len(self.text), len(self.text), more)

    def edit(self, start: int, stop: int, new: str) -> int:
        """Put ``new`` in place of the characters from ``start`` to ``stop``;
        returns how many pieces were encoded anew."""
        ends = [*self.begins[1:], len(self.text)][:len(self.begins)]
        keep = 0
        while keep < len(ends) and ends[keep] + AHEAD <= start:
            keep += 1
        shift = len(new) - (stop - start)
        text = self.text[:start] + new + self.text[stop:]
        at = self.begins[keep] if keep < len(self.begins) else (ends or [0])[-1]
        later = {b + shift: k for k, b in enumerate(self.begins) if b >= stop}
        begins, found = self.begins[:keep], self.found[:keep]
        done = 0
        for a, b in self.encoder.splitter.spans(text, min(at, start)):
            if a >= start + len(new) and a in later:
                k = later[a]
                begins += [x + shift for x in self.begins[k:]]
                found += self.found[k:]
                break
            begins.append(a)
            found.append(self.encoder[text[a:b]])
            done += 1
        self.text, self.begins, self.found = text, begins, found
        return done


def _read(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@lru_cache(maxsize=4)
def load_ranks(path: str) -> Ranks:
    return Ranks(_read(path))


@lru_cache(maxsize=4)
def load_words(path: str) -> dict[int, bytes]:
    return {i: w for w, i in _read(path).items()}


@lru_cache(maxsize=4)
def _encoder(path: str, pattern: str, odd: tuple[tuple[int, int], ...]) -> Encoder:
    """A worker's encoder, kept from task to task."""
    return Encoder(load_ranks(path), Splitter(pattern, dict(odd)))


@lru_cache(maxsize=1)
def odd_code_points() -> dict[int, int]:
    """Code points that this Unicode version of the pattern library takes for
    a letter, number or space and the tokenizer's library doesn't, or the other
    way round, each with a stand-in of its right class."""
    import tiktoken
    points = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
    single = {bytes([k]): k for k in range(256)}
    odd: dict[int, int] = {}
    right: dict[int, str] = {}
    for kind, cls in (("L", r"\p{L}"), ("N", r"\p{N}"), ("s", r"\s")):
        other = tiktoken.Encoding(cls, pat_str=cls, mergeable_ranks=single, special_tokens={})
        theirs = set(map(ord, other.decode_bytes(other.encode_ordinary(points)).decode()))
        ours = set(map(ord, regex.findall(cls, points)))
        right.update(dict.fromkeys(theirs, kind))
        odd.update(dict.fromkeys(theirs ^ ours, 0))
    return {c: _STAND_INS[right.get(c, "")] for c in sorted(odd)}


def _kept(rows: DataFrame, new: str) -> tuple[list[str], str]:
    """Columns besides ``new``, and a name that none of them has."""
    kept = [c for c in rows.columns if c.lower() != new.lower()]
    return kept, "_" * (1 + max(map(len, kept), default=0))


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with the ids of every whole text."""
    odd = tuple(odd_code_points().items())
    kept, source = _kept(docs, ids_col)
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], F.make_valid_utf8(F.col(f"`{text_col}`")).alias(source))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, pattern, odd)
        for batch in batches:
            for part in slices(batch, source):
                each = [np.fromiter(encoder.encode(t or ""), np.int32) for t in part.column(source).to_pylist()]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in each])])
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(each)))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], ids], [*kept, ids_col])
    return rows.mapInArrow(run, rows.select(*[F.col(f"`{c}`") for c in kept]).schema.add(ids_col, ArrayType(IntegerType())))


def decode(rows: DataFrame, path: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """``rows`` with the bytes that the ids of each stand for."""
    kept, ids = _kept(rows, bytes_col)
    coded = rows.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{ids_col}`").alias(ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word = load_words(path).__getitem__
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                flat = part.column(ids).flatten().to_numpy().tolist()
                ends = np.cumsum(pc.list_value_length(part.column(ids)).fill_null(0).to_numpy()).tolist()
                out = [b"".join(map(word, flat[a:b])) for a, b in zip([0, *ends], ends)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(out, pa.binary())], [*kept, bytes_col])
    return coded.mapInArrow(run, coded.select(*[F.col(f"`{c}`") for c in kept]).schema.add(bytes_col, "binary"))


def op13_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Number and digest of the ids of every whole text, and the digest of what they decode to."""
    import public_tokenizers
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    encoded = encode(docs, path, public_tokenizers.PATTERN).select("doc_id", "ids")
    return decode(encoded, path).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
