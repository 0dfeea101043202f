"""Vector code compression: product codes from exact integer k-means (operator 12).

Each component x becomes ``floor(scale * x)``, and a vector is cut into
``parts`` equal consecutive parts.  The codebook of a part position starts with
that part of the smallest ids and is refined in ``rounds`` rounds; a vector's
code holds, part by part, the number of its nearest codebook entry.

1. All parts of one position are sorted along a Hilbert curve and lie in *flat
   blocks* of ``block`` parts.  A block stores its members, the smallest box
   around them and their sum.  The blocks are written once.
2. A round reads the blocks once.  From the distances between box and entries
   a block's *shortlist* follows: entries whose least distance to the box is no
   more than the smallest of the greatest distances.  No other entry can be
   nearest to a member, not even by a tie.  A block with one entry on its list
   adds its stored sum; in others a kernel over members x shortlist decides.
3. A task adds up (count, sum) per entry, and the sums of all tasks are
   aggregated by (position, entry).  The driver receives one row per entry.

All numbers are whole and exact at any size: a kernel computes in doubles while
they hold every distance exactly, else in 64-bit, else in Python's integers,
block by block.  ``error`` and ``label_error`` stop at 2**63 - 1.  Parts are dealt
by range of (position, curve, hash of the row), so a vector that a third of all
rows share is spread, and its blocks are points that cost one comparison.

Rows whose vector is null or holds null or non-finite components take no part.
Shorter vectors count as padded with zeros, to a multiple of ``parts``.  Rows with
null ids are coded like others and come last in the choice of first entries; rows
with equal ids are ordered by their vectors.  With fewer rows than entries the
codebook has as many entries as rows.  Repeated rows are coded each.  Null labels
are one group.  An empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
BLOCK = 128
#: labels up to this number are joined by a broadcast; beyond it by a salted join
FEW_LABELS = 100_000
LABEL_SALTS = 64
_LONG = (1 << 63) - 1
#: bits of a curve position, of one coordinate at most, and dimensions with one bit
_KEY_BITS, _AXIS_BITS = 62, 8


# ---------------------------------------------------------------- numbers
def scaled(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """``floor(scale * x)``: 64-bit, or Python integers if these don't fit."""
    with np.errstate(over="ignore"):
        v = np.floor(x * float(scale))
    if not v.size or np.abs(v).max() < 2.0 ** 52:
        return v.astype(np.int64)
    # a double beyond 2**52 is whole
    big = [int(t) * scale if abs(t) >= 2.0 ** 52 else math.floor(t * scale) for t in x.ravel().tolist()]
    return np.array(big, object).reshape(x.shape)


def _reach(a: np.ndarray) -> int:
    return max(-int(a.min()), int(a.max())) if a.size else 0


def _kernel_type(most: int, dims: int):
    """A number type that holds every distance between values up to ``most``."""
    largest = 4 * dims * most * most
    return np.float64 if largest < 1 << 53 else np.int64 if largest < 1 << 62 else object


def hilbert_keys(q: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of ``q`` (numbers below
    2**bits); all bits together are at most 62."""
    x = np.ascontiguousarray(q.T).astype(np.uint64)
    one = np.uint64(1)
    if not len(x):
        return np.zeros(len(q), np.int64)
    # turn every sub-cube to the orientation that its place on the curve has
    for level in range(bits - 1, 0, -1):
        bit = np.uint64(1 << level)
        below = bit - one
        for axis in x:
            up = (axis & bit) != 0
            swap = np.where(up, np.uint64(0), (x[0] ^ axis) & below)
            x[0] ^= np.where(up, below, swap)
            axis ^= swap
    # Gray code over the axes
    for k in range(1, len(x)):
        x[k] ^= x[k - 1]
    flip = np.zeros(x.shape[1], np.uint64)
    for level in range(bits - 1, 0, -1):
        bit = np.uint64(1 << level)
        flip ^= np.where((x[-1] & bit) != 0, bit - one, np.uint64(0))
    x ^= flip
    key = np.zeros(x.shape[1], np.uint64)
    for level in range(bits - 1, -1, -1):
        for axis in x:
            key = key << one | axis >> np.uint64(level) & one
    return key.astype(np.int64)


# ---------------------------------------------------------------- blocks
def _store(a: np.ndarray) -> bytes:
    """Whole numbers as bytes: 4 or 8 each, or as text beyond 64 bits."""
    if a.dtype == object:
        if _reach(a) >= 1 << 63:
            return b"t" + json.dumps(a.ravel().tolist()).encode()
        a = a.astype(np.int64)
    return b"i" + a.astype(np.int32).tobytes() if _reach(a) < 1 << 31 else b"l" + a.tobytes()


def _load(data: bytes, dims: int) -> np.ndarray:
    kind = data[:1]
    flat = np.array(json.loads(data[1:]), object) if kind == b"t" \
        else np.frombuffer(data, np.int32 if kind == b"i" else np.int64, offset=1).astype(np.int64)
    return flat.reshape(-1, dims)


def shortlist(low: np.ndarray, high: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Entries that can be nearest to a point of the box."""
    outside = np.maximum(np.maximum(low - entries, entries - high), 0)
    across = np.maximum(abs(entries - low), abs(high - entries))
    least, most = (outside * outside).sum(1), (across * across).sum(1)
    return np.flatnonzero(least <= most.min())


def nearest(x: np.ndarray, entries: np.ndarray, listed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest of the listed entries, squared distance) of each row of ``x``;
    ties go to the lower number."""
    gap = x[:, None, :] - entries[listed][None]
    distance = (gap * gap).sum(2)
    best = distance.argmin(1)
    return listed[best], distance[np.arange(len(x)), best]


def _typed(box: np.ndarray, entries: np.ndarray):
    return _kernel_type(max(_reach(box), _reach(entries)), entries.shape[1])


def block_sums(box: np.ndarray, members, entries: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(entry, count, sum) of one block.  ``box`` has rows low, high, sum;
    ``members()`` reads its members, if more than one entry is listed."""
    kind = _typed(box[:2], entries)
    listed = shortlist(box[0].astype(kind), box[1].astype(kind), entries.astype(kind))
    if len(listed) == 1:
        yield int(listed[0]), 0, box[2]
        return
    x = members()
    own, _ = nearest(x.astype(kind), entries.astype(kind), listed)
    for e in np.unique(own).tolist():
        mine = own == e
        yield e, int(mine.sum()), x[mine].sum(0)


_BLOCKS = "part int, n int, rows binary, members binary, box binary"


def flat_blocks(rows: DataFrame, width: int, parts: int, scale: int, block: int, limits: np.ndarray) -> DataFrame:
    """Blocks of (row, x): the parts of each position along the curve.
    ``limits`` (lowest, highest) frame the grid of the curve."""
    dims = width // parts
    bits = max(1, min(_AXIS_BITS, _KEY_BITS // dims))
    axes = min(dims, _KEY_BITS)
    low, high = limits
    step = np.where(high > low, (high - low) / (1 << bits), 1.0)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("x"), width)
            cell = np.clip((x - low) / step, 0, (1 << bits) - 1).astype(np.uint64)
            n, size = len(x), dims * 8
            for p in range(parts):
                at = slice(p * dims, (p + 1) * dims)
                key = hilbert_keys(cell[:, at][:, :axes], bits)
                data = pa.Array.from_buffers(pa.binary(), n, [
                    None, pa.py_buffer(np.arange(0, (n + 1) * size, size, dtype=np.int32).tobytes()),
                    pa.py_buffer(np.ascontiguousarray(x[:, at]).tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, p, np.int32)), pa.array(key),
                                                  batch.column("row"), data], ["part", "key", "row", "data"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        now = None

        def flush(least: int):
            """Blocks of what is held, while there are ``least`` rows."""
            nonlocal held
            if not held:
                return
            ids, x = (np.concatenate(c) for c in zip(*held))
            done, out = 0, []
            while len(ids) - done >= max(least, 1):
                m = slice(done, done + block)
                v = scaled(x[m], scale)
                box = np.stack([v.min(0), v.max(0), v.sum(0)])
                out.append((now, len(v), ids[m].tobytes(), _store(v), _store(box)))
                done += block
            held = [(ids[done:], x[done:])] if done < len(ids) else []
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int32(), *[pa.binary()] * 3))],
                    ["part", "n", "rows", "members", "box"])

        for batch in batches:
            part = batch.column("part").to_numpy()
            ids = batch.column("row").to_numpy()
            x = np.frombuffer(b"".join(batch.column("data").to_pylist()), np.float64).reshape(len(part), dims)
            edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
            for a, b in zip(edges, edges[1:]):
                if b == a:
                    continue
                if part[a] != now:
                    yield from flush(1)
                    now = int(part[a])
                held.append((ids[a:b], x[a:b]))
                yield from flush(block)
        yield from flush(1)

    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.count() * parts // 2_000_000)
    pieces = rows.select("row", "x").mapInArrow(cut, "part int, key long, row long, data binary")
    return pieces.repartitionByRange(tasks, "part", "key", F.xxhash64("row")) \
        .sortWithinPartitions("part", "key").mapInArrow(build, _BLOCKS)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of doubles, padded with zeros."""
    size = pc.list_value_length(column).to_numpy()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = np.zeros((len(size), width))
    x[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return x


# ---------------------------------------------------------------- rounds
_SUMS = "part int, entry int, n long, total array<string>"


def _round(blocks: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one more round."""
    dims = books[0].shape[1]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: dict[tuple[int, int], int] = {}
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            part, size = batch.column("part").to_pylist(), batch.column("n").to_pylist()
            members, boxes = batch.column("members"), batch.column("box").to_pylist()
            for k, p in enumerate(part):
                for e, n, s in block_sums(_load(boxes[k], dims), lambda: _load(members[k].as_py(), dims), books[p]):
                    count[p, e] = count.get((p, e), 0) + (n or size[k])
                    total[p, e] = total.get((p, e), 0) + s.astype(object)
        keys = sorted(count)
        yield pa.RecordBatch.from_arrays([
            pa.array([p for p, _ in keys], pa.int32()), pa.array([e for _, e in keys], pa.int32()),
            pa.array([count[x] for x in keys], pa.int64()),
            pa.array([list(map(str, total[x])) for x in keys], pa.list_(pa.string()))], ["part", "entry", "n", "total"])

    def merge(table: pa.Table) -> pa.Table:
        total = [sum(map(int, c)) for c in zip(*table["total"].to_pylist())]
        return pa.table({"part": table["part"].slice(0, 1), "entry": table["entry"].slice(0, 1),
                         "n": pa.array([sum(table["n"].to_pylist())], pa.int64()),
                         "total": pa.array([list(map(str, total))], pa.list_(pa.string()))})

    # one row per entry: positions x entries, both parameters
    found = blocks.select("part", "n", "members", "box").mapInArrow(add, _SUMS) \
        .groupBy("part", "entry").applyInArrow(merge, _SUMS).collect()
    out = [b.astype(object) for b in books]
    for r in found:
        out[r["part"]][r["entry"]] = [int(t) // r["n"] for t in r["total"]]
    return [_small(b) for b in out]


def _small(a: np.ndarray) -> np.ndarray:
    return a.astype(np.int64) if _reach(a) < 1 << 62 else a


def _first_entries(rows: DataFrame, width: int, parts: int, entries: int, scale: int) -> list[np.ndarray]:
    first = rows.orderBy(F.asc_nulls_last("id"), "x").limit(entries).select("x").collect()  # ``entries`` rows
    x = np.zeros((len(first), width))
    for k, r in enumerate(first):
        x[k, :len(r["x"])] = r["x"]
    v = scaled(x, scale)
    return [_small(b) for b in np.split(v, parts, axis=1)]


def _assign(blocks: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """(row, part, entry, error) of every part."""
    dims = books[0].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for p, rows, members, box in zip(*[batch.column(c).to_pylist() for c in ("part", "rows", "members", "box")]):
                frame, x, book = _load(box, dims)[:2], _load(members, dims), books[p]
                kind = _typed(frame, book)
                listed = shortlist(frame[0].astype(kind), frame[1].astype(kind), book.astype(kind))
                own, error = nearest(x.astype(kind), book.astype(kind), listed)
                if kind is object:
                    error = np.array([min(e, _LONG) for e in error.tolist()], np.int64)
                out.append((np.frombuffer(rows, np.int64), np.full(len(x), p, np.int32), own.astype(np.int32),
                            error.astype(np.int64)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)],
                                                 ["row", "part", "entry", "error"])
    return blocks.select("part", "rows", "members", "box").mapInArrow(run, "row long, part int, entry int, error long")


def _capped(total: Column) -> Column:
    return F.least(total, F.lit(_LONG).cast("decimal(38,0)")).cast("long")


def _with_label_errors(coded: DataFrame) -> DataFrame:
    """``coded`` with the errors of equal labels summed."""
    sums = materialize(coded.groupBy("label").agg(_capped(F.sum(F.col("error").cast("decimal(38,0)")))
                                                  .alias("label_error")), "label_errors")
    sums = sums.withColumnRenamed("label", "_label")
    match = F.col("label").eqNullSafe(F.col("_label"))
    if sums.count() <= FEW_LABELS:
        return coded.join(F.broadcast(sums), match).drop("_label")
    salts = F.explode(F.sequence(F.lit(0), F.lit(LABEL_SALTS - 1)))
    salted = coded.withColumn("_salt", F.pmod(F.xxhash64("row"), F.lit(LABEL_SALTS)).cast("int"))
    return salted.join(sums.withColumn("_s", salts), match & (F.col("_salt") == F.col("_s"))).drop("_label", "_salt", "_s")


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
             parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
             block: int = BLOCK) -> tuple[DataFrame, list[np.ndarray]]:
    """((id, label, code, error, label_error), codebooks): a code is two hex
    digits for each part; a codebook has one row per entry."""
    if not 1 <= entries <= 256:
        raise ValueError("entries must lie between 1 and 256")
    v = F.col(f"`{vector_col}`")
    good = v.isNotNull() & F.forall(v, lambda x: F.coalesce(
        x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    rows = vectors.where(good).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").alias("label"),
                                      v.alias("x"), F.monotonically_increasing_id().alias("row"))
    rows = materialize(rows, "vectors")
    width = rows.agg(F.max(F.size("x"))).first()[0]
    if width is None:
        return rows.select("id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"),
                           F.lit(0).cast("long").alias("label_error")).where(F.lit(False)), []
    width = max(1, -(-width // parts)) * parts
    limits = np.zeros((2, width))
    # two numbers for each component; far values don't stretch the grid
    for r in rows.select(F.posexplode(F.transform("x", lambda t: t.cast("double"))).alias("p", "c")) \
            .groupBy("p").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.avg("c").alias("m"),
                              F.coalesce(F.stddev_pop("c"), F.lit(0.0)).alias("s")).collect():
        spread = 3 * r["s"]
        if math.isfinite(r["m"]) and math.isfinite(spread):
            limits[:, r["p"]] = max(r["lo"], r["m"] - spread), min(r["hi"], r["m"] + spread)
    blocks = materialize(flat_blocks(rows, width, parts, scale, block, limits), "blocks")
    books = _first_entries(rows, width, parts, entries, scale)
    for _ in range(rounds):
        books = _round(blocks, books)
    digits = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "entry"))),
                                      lambda e: F.lower(F.lpad(F.hex(e["entry"]), 2, "0"))), "")
    coded = _assign(blocks, books).groupBy("row").agg(
        digits.alias("code"), _capped(F.sum(F.col("error").cast("decimal(38,0)"))).alias("error"))
    coded = materialize(coded.join(rows.select("row", "id", "label"), "row"), "codes")
    return _with_label_errors(coded).select("id", "label", "code", "error", "label_error"), books


def codebooks_sha256(books: list[np.ndarray]) -> str:
    """Digest of all entries: decimal components by part, entry and position."""
    return hashlib.sha256(",".join(str(int(c)) for b in books for c in b.ravel().tolist()).encode()).hexdigest()


def op12_vector_codes(spark, sf_dir: str) -> DataFrame:
    """Code, error and its label's error of every vector."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    codes, books = compress(vectors)
    return codes.select(F.col("id").alias("vec_id"), "code", "error", "label_error",
                        F.lit(codebooks_sha256(books)).alias("codebooks_sha256"))
