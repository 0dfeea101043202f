"""Best-fit packing of tokenised documents into sequences (operator 5).

1. Every text is tokenised whole, in the tasks that read it; a document's ids
   end with ``end_id``, and only documents longer than a sequence are cut.
2. The histogram of piece lengths (at most ``capacity`` numbers, whatever the
   corpus) goes to the driver.  A *configuration* is a multiset of lengths
   that fits into one sequence.  The covering linear program "fewest
   configurations that cover the histogram" is solved by multiplicative
   weights: a knapsack dynamic program finds the configuration of the highest
   price, whose use lowers the prices of its lengths.  Prices give a lower
   bound of any packing, and the rounds end at a stated gap to it.
3. The uses are rounded down, then up where pieces are left; what the rounded
   uses don't hold is packed best fit, longest first, also on counts of lengths.
4. Pieces of one length are interchangeable, so a piece's number among those
   of its length says which sequence and offset it gets.  The numbers are made
   from counts of (length, salt), so a length that a third of all pieces has
   is no single task's work.

The plan sent to the tasks has one pattern for each configuration used, at
most a few thousand, of at most sqrt(2 * capacity) different lengths each,
whatever the number of documents.

Null text counts as empty, and an empty text is one piece, ``end_id`` alone.
Repeated rows are packed each; null ids are kept; an empty table gives an
empty result.
"""

from __future__ import annotations

import bisect
import gc
import math
import os
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .words import hash_words, split_words

CAPACITY = 4096
END_ID = 1
#: part of the highest price that a configuration used in the same round may lack
NEAR = 0.01
#: the program's gap to its bound, the first step of a length's share, and steps of the
#: knapsack (one for each length and round) after which it ends
GAP, STEP, WORK = 0.001, 0.4, 60_000
#: text bytes that a task holds in words at once
SLICE_BYTES = 4 << 20
#: distinct words whose ids a worker remembers
REMEMBERED = 4_000_000
_MARK = "\0"


def slices(batch: pa.RecordBatch, text_col: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in parts of about ``most`` bytes of text; each has
    at least one row."""
    size = pc.binary_length(batch.column(text_col)).fill_null(0).to_numpy(zero_copy_only=False)
    part = np.cumsum(size) // most
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)


class WordIds:
    """Ids of words by their hash.  Texts split at white space are tokenised
    word by word with the same result, so each distinct word is encoded once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        mark = self.tok.encode(_MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _encode(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(words, add_special_tokens=False)]

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in a row, ids of each)."""
        ids: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        for k in range(0, len(words), 512):
            part = words[k:k + 512]
            if self.mark is not None and not any(_MARK in x for x in part):
                got = np.array(self._encode([f" {_MARK} ".join(part)])[0], np.uint32)
                marks = np.flatnonzero(got == self.mark)
                if len(marks) == len(part) - 1:
                    ids.append(got[got != self.mark])
                    sizes.append(np.diff(np.concatenate([[-1], marks, [len(got)]])) - 1)
                    continue
            each = self._encode(part)
            ids.append(np.array([x for e in each for x in e], np.uint32))
            sizes.append(np.array([len(e) for e in each], np.int64))
        if not ids:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        return np.concatenate(ids), np.concatenate(sizes)

    def learn(self, keys: np.ndarray, words: list[str]) -> None:
        ids, size = self.encode(words)
        at = len(self.ids) + np.cumsum(size) - size
        self.ids = np.concatenate([self.ids, ids])
        keys, at, size = (np.concatenate(x) for x in ((self.keys, keys), (self.at, at), (self.size, size)))
        order = np.argsort(keys, kind="stable")
        self.keys, self.at, self.size = keys[order], at[order], size[order]

    def texts(self, column, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, where each begins)."""
        w = split_words(column)
        h = hash_words(w)
        if len(self.keys) > REMEMBERED:
            self.forget()
        order = np.argsort(h, kind="stable")
        s = h[order]
        new = np.ones(len(s), bool)
        new[1:] = s[1:] != s[:-1]
        uniq, one = s[new], order[new]
        at = np.searchsorted(self.keys, uniq)
        known = np.zeros(len(uniq), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == uniq[inside]
        if not known.all():
            data = w.buf.tobytes()
            miss = one[~known]
            self.learn(uniq[~known], [data[a:b].decode("utf-8", "replace") for a, b in
                                      zip(w.starts[miss].tolist(), w.ends[miss].tolist())])
            at = np.searchsorted(self.keys, uniq)
        which = np.empty(len(h), np.int64)
        which[order] = at[np.cumsum(new) - 1]
        size, begin = self.size[which], self.at[which]
        total = np.concatenate([[0], np.cumsum(size)])
        extra = int(end_id is not None)
        n = len(w.first) - 1
        first = total[w.first] + extra * np.arange(n + 1)
        out = np.empty(int(first[-1]), np.uint32)
        # ids of word k go to total[k] + its text's number of earlier end ids
        to = np.arange(int(total[-1])) + extra * np.repeat(w.doc(), size)
        out[to] = self.ids[np.arange(int(total[-1])) + np.repeat(begin - total[:-1], size)]
        if extra:
            out[first[1:] - 1] = end_id
        return out, first


_MADE: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """This worker's tokeniser for ``path``, with the words it has met."""
    if path not in _MADE:
        _MADE[path] = WordIds(path)
    return _MADE[path]


def cut_pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
               capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32) and, if asked for, the ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_ids(tokenizer)
        collecting = gc.isenabled()
        gc.disable()  # many small lists, none in a cycle
        try:
            for batch in batches:
                for part in slices(batch, text_col):
                    ids, first = encoder.texts(part.column(text_col), end_id)
                    n = np.diff(first)
                    pieces = -(-n // capacity)
                    doc = np.repeat(np.arange(len(n)), pieces)
                    piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                    start = piece * capacity
                    length = np.minimum(n[doc] - start, capacity)
                    a = first[doc] + start
                    raw = memoryview(ids.astype("<u4").tobytes())
                    crc = [zlib.crc32(raw[4 * x:4 * (x + y)]) for x, y in zip(a.tolist(), length.tolist())]
                    cols = [part.column(id_col).take(pa.array(doc)), pa.array(piece, pa.int32()),
                            pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                    names = [id_col, "piece", "start", "length", "ids_crc32"]
                    if with_ids:
                        cols.append(pa.ListArray.from_arrays(
                            pa.array(np.concatenate([[0], np.cumsum(length)]), pa.int32()), pa.array(ids, pa.int32())))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(cols, names)
        finally:
            if collecting:
                gc.enable()

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(f"`{id_col}`", f"`{text_col}`").mapInArrow(run, schema)


# ------------------------------------------------------------------ the plan
def _knapsack(lengths: np.ndarray, price: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(highest total price within each room, a length to begin with there), by
    dynamic programming over the lengths: 1, 2, 4, ... more copies of each."""
    best = np.zeros(capacity + 1)
    pick = np.zeros(capacity + 1, np.int64)
    for length, value in zip(lengths.tolist(), price.tolist()):
        copies = 1
        while copies * length <= capacity:
            total = best[:capacity + 1 - copies * length] + copies * value
            room = np.flatnonzero(total > best[copies * length:] * (1 + 1e-12))
            best[room + copies * length] = total[room]
            pick[room + copies * length] = length
            copies *= 2
    return best, pick


def best_configuration(price: np.ndarray, capacity: int) -> dict[int, int]:
    """The multiset of lengths within ``capacity`` of the highest total price.
    ``price[l]`` is the price of length l, -inf if there is none; ``price[0]`` is unused."""
    lengths = np.flatnonzero(price[1:] > 0) + 1
    _, pick = _knapsack(lengths, price[lengths], capacity)
    out: dict[int, int] = {}
    room = capacity
    while length := int(pick[room]):
        out[length] = out.get(length, 0) + 1
        room -= length
    return out


@dataclass
class Program:
    """A solution of the covering program: uses of configurations, their sum
    when every piece is covered, and a lower bound of any solution's."""
    uses: dict[tuple[tuple[int, int], ...], float]
    value: float
    bound: float
    rounds: int


def solve_configurations(demand: np.ndarray, capacity: int, gap: float = GAP, rounds: int | None = None) -> Program:
    """The fractional covering program "fewest configurations that cover
    ``demand``", by multiplicative weights.

    A length's price is its size times ``exp(-share)``, where its share is how
    often its pieces are covered so far: prices multiply up and down as the
    configurations used cover more or less of a length than of the others.  A
    round prices all configurations by one knapsack; prices divided by the
    highest total are feasible for the dual program, which gives the bound.  The
    best configuration is used, and others within ``NEAR`` of it that need
    lengths the round has not used up; a round raises no share by more than its
    step, which falls with the square root of the rounds (the width of the
    program, bounded).  All uses divided by the smallest share cover
    everything; the rounds end when that is within ``gap`` of the bound or of the
    next whole number, or after ``WORK`` steps of the knapsack."""
    lengths = np.flatnonzero(demand)
    need = demand[lengths].astype(float)
    number = np.zeros(capacity + 1, np.int64)
    number[lengths] = np.arange(len(lengths))
    covered, prices = np.zeros(len(lengths)), np.zeros(len(lengths))
    uses: dict[tuple[tuple[int, int], ...], float] = defaultdict(float)
    total = bound = 0.0
    most = max(20, WORK // max(1, len(lengths))) if rounds is None else rounds
    done, value = 0, float("inf")
    while len(lengths) and done < most and value > max((1 + gap) * bound, math.ceil(bound)):
        done += 1
        share = covered / need
        price = lengths * np.exp(share.min() - share)
        best, pick = _knapsack(lengths, price, capacity)
        top = best[capacity]
        prices += price / top
        bound = max(bound, need @ price / top)
        if done % 16 == 0:                      # the mean of all prices is feasible too, and steadier
            bound = max(bound, need @ prices / _knapsack(lengths, prices, capacity)[0][capacity])
        left = STEP / math.sqrt(1 + done / 8) * need
        value_with = price + best[capacity - lengths]
        fresh = np.ones(capacity + 1, bool)     # lengths that the round may still use
        for k in np.argsort(-value_with, kind="stable").tolist():
            if value_with[k] < (1 - NEAR) * top:
                break
            if not fresh[lengths[k]]:
                continue
            config = _with_length(int(lengths[k]), lengths, price, best, pick, capacity, fresh)
            held = number[list(config)]
            copies = np.fromiter(config.values(), float)
            if price[held] @ copies < (1 - NEAR) * top:
                continue
            times = float((left[held] / copies).min())
            left[held] -= copies * times
            fresh[lengths[held[left[held] <= 1e-9 * need[held]]]] = False
            covered[held] += copies * times
            uses[tuple(sorted(config.items()))] += times
            total += times
        least = (covered / need).min()
        value = total / least if least > 0 else float("inf")
    scale = (covered / need).min() if done else 1.0
    return Program({c: n / scale if scale > 0 else n for c, n in uses.items()}, value if done else 0.0, bound, done)


def _with_length(length: int, lengths: np.ndarray, price: np.ndarray, best: np.ndarray, pick: np.ndarray,
                 capacity: int, fresh: np.ndarray) -> dict[int, int]:
    """A configuration of a high price with ``length`` in it, of fresh lengths."""
    out: dict[int, int] = {}
    room = capacity
    while length:
        out[length] = out.get(length, 0) + 1
        room -= length
        length = int(pick[room])
        if length and not fresh[length]:
            fit = lengths[:np.searchsorted(lengths, room, "right")]
            worth = np.where(fresh[fit], price[:len(fit)] + best[room - fit], -1.0)
            k = int(worth.argmax())
            length = int(fit[k]) if worth[k] >= 0 else 0
    return out


def round_uses(program: Program, demand: np.ndarray, capacity: int, waste: int, part: float = 1.0) -> dict[tuple, int]:
    """Whole uses of configurations with at most ``waste`` tokens free: first
    the uses (or ``part`` of each) rounded down, then one more of those with the
    largest fractions, as long as pieces are left for them."""
    free = demand.astype(np.int64).copy()
    whole: dict[tuple, int] = {}
    some = [(c, n * part) for c, n in program.uses.items() if capacity - sum(x * k for x, k in c) <= waste]
    some.sort(key=lambda x: (-x[1], x[0]))
    parts = []
    for config, n in some:
        times = min([math.floor(n + 1e-6), *(free[x] // k for x, k in config)])
        parts.append((math.floor(n) - n, config))
        if times > 0:
            whole[config] = int(times)
            for x, k in config:
                free[x] -= k * times
    for _, config in sorted(parts):
        if all(free[x] >= k for x, k in config):
            whole[config] = whole.get(config, 0) + 1
            for x, k in config:
                free[x] -= k
    return whole


def _best_fit(demand: np.ndarray, capacity: int, whole: dict[tuple, int]) -> list[tuple[dict[int, int], int]]:
    """The full sequences ``whole``, and the other pieces best fit."""
    left = demand.copy()
    open_bins: dict[int, list[tuple[dict[int, int], int]]] = defaultdict(list)
    for config, n in whole.items():
        for length, k in config:
            left[length] -= n * k
        open_bins[0].append((dict(config), n))
    rooms = sorted(open_bins)

    def put(room: int, config: dict[int, int], n: int) -> None:
        if room not in open_bins or not open_bins[room]:
            bisect.insort(rooms, room)
        open_bins[room].append((config, n))

    for length in np.flatnonzero(left)[::-1].tolist():
        n = int(left[length])
        while n:
            k = bisect.bisect_left(rooms, length)
            if k == len(rooms):
                per = capacity // length
                if full := n // per:
                    put(capacity - per * length, {length: per}, full)
                if n % per:
                    put(capacity - (n % per) * length, {length: n % per}, 1)
                break
            room = rooms[k]
            config, many = open_bins[room].pop()
            if not open_bins[room]:
                rooms.pop(k)
            use = min(many, n)
            if use < many:
                put(room, config, many - use)
            put(room - length, {**config, length: config.get(length, 0) + 1}, use)
            n -= use
    return [x for room in sorted(open_bins) for x in open_bins[room]]


def pack_histogram(demand: np.ndarray, capacity: int = CAPACITY, rounds: int | None = None) -> list[tuple[dict[int, int], int]]:
    """Patterns (lengths with their numbers) and whole numbers of sequences
    that hold exactly the pieces of ``demand``."""
    return plan_histogram(demand, capacity, rounds)[0]


def plan_histogram(demand: np.ndarray, capacity: int = CAPACITY, rounds: int | None = None) \
        -> tuple[list[tuple[dict[int, int], int]], dict]:
    """The same, and figures: bound, value and rounds of the program, sequences
    in all, and the share of tokens in sequences that the program placed (of
    those in pieces shorter than a sequence)."""
    left = demand.astype(np.int64).copy()
    patterns: list[tuple[dict[int, int], int]] = []
    if left[capacity]:
        patterns.append(({capacity: 1}, int(left[capacity])))
        left[capacity] = 0
    program = solve_configurations(left, capacity, rounds=rounds)
    # all roundings keep uses of the program; they differ in the free room that these
    # may leave and in how much is left to the packing of the rest
    ways = []
    steady = program.bound / program.value if program.value else 1.0     # 1 at the optimum
    for waste, part in ((capacity, 1.0), (capacity, steady), (0, steady), (capacity, steady / 2),
                        *((0, steady / k) for k in (2, 4, 8, 16, 32))):
        whole = round_uses(program, left, capacity, waste, part)
        way = _best_fit(left, capacity, whole)
        ways.append((sum(n for _, n in way), -len(ways), way, whole))
        if ways[-1][0] <= math.ceil(program.bound - 1e-6):
            break
    count, _, way, whole = min(ways, key=lambda w: w[:2])
    tokens = int(left @ np.arange(capacity + 1))
    placed = sum(n * x * k for config, n in whole.items() for x, k in config)
    return patterns + way, {"bound": program.bound, "value": program.value, "rounds": program.rounds,
                            "sequences": count, "placed": placed / tokens if tokens else 1.0}


def _slots(patterns: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """Rows (length, first number, copies, first sequence, offset), sorted:
    the pieces of a length from ``first number`` on go ``copies`` to a sequence."""
    taken: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for config, times in patterns:
        offset = 0
        for length, copies in sorted(config.items(), reverse=True):
            rows.append((length, taken[length], copies, sequence, offset))
            taken[length] += copies * times
            offset += length * copies
        sequence += times
    out = np.array(rows, np.int64).reshape(-1, 5)
    return out[np.lexsort((out[:, 1], out[:, 0]))]


_NUMBER = 1 << 48


def pack(pieces: DataFrame, capacity: int = CAPACITY, rounds: int | None = None) -> DataFrame:
    """``pieces`` (with a column ``length``) with ``sequence_id`` and ``offset``."""
    spark = pieces.sparkSession
    pieces = materialize(pieces.withColumn("_pid", F.monotonically_increasing_id()), "pieces")
    demand = np.zeros(capacity + 1, np.int64)
    for row in pieces.groupBy("length").count().collect():  # at most ``capacity`` rows
        demand[row["length"]] = row["count"]
    slots = spark.sparkContext.broadcast(_slots(pack_histogram(demand, capacity, rounds)))
    salts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(demand.sum()) // 1_000_000)
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("_pid"), F.lit(salts)).cast("int"))
    before = salted.groupBy("length", "_salt").count().select(
        "length", "_salt", (F.sum("count").over(Window.partitionBy("length").orderBy("_salt")) - F.col("count"))
        .alias("_before"))
    numbered = salted.withColumn("_n", F.row_number().over(Window.partitionBy("length", "_salt").orderBy("_pid"))) \
        .join(before, ["length", "_salt"]) \
        .withColumn("_n", F.col("_before") + F.col("_n") - 1).drop("_salt", "_before", "_pid")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = slots.value
        keys = table[:, 0] * _NUMBER + table[:, 1]
        for batch in batches:
            length, n = batch.column("length").to_numpy(), batch.column("_n").to_numpy()
            k = np.searchsorted(keys, length * _NUMBER + n, "right") - 1
            over = n - table[k, 1]
            copies = np.maximum(table[k, 2], 1)
            cols = [batch.column(c) for c in names] + [
                pa.array(table[k, 3] + over // copies), pa.array(table[k, 4] + over % copies * length)]
            yield pa.RecordBatch.from_arrays(cols, [*names, "sequence_id", "offset"])

    names = [c for c in pieces.columns if c != "_pid"]
    schema = pieces.select(names).schema.add("sequence_id", "long").add("offset", "long")
    return numbered.select(*names, "_n").mapInArrow(place, schema)


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                   capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pieces of every document with the sequence and offset each has."""
    return pack(cut_pieces(docs, tokenizer, id_col, text_col, capacity, end_id, with_ids), capacity)


def op5_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """One row per piece of every document."""
    import public_tokenizers
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
