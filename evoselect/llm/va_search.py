"""Exact top-k inner-product search by vector-approximation files (operator 4).

Each component x becomes the integer ``floor(scale * x)``.  A vector's
*approximation* is the cell number of each integer in ``2**bits`` equal cells
between the smallest and largest integer of its dimension.  From a cell's
borders come a lower and an upper bound of its inner product with a query:

1. scan the approximations: every (query block, vector block) gives each query
   its ``k`` best lower bounds there, and the k-th best over all blocks is a
   score that at least k vectors reach;
2. scan again: vectors whose upper bound reaches that score are candidates;
3. read exact vectors in the order of the bounds: the best ``first`` candidates
   of a query fix a k-th exact score, then only candidates whose bound still
   reaches it are read, after which the result is certain.

Rows with the same integers form a *class*, which keeps its ``k + 1`` smallest ids
(``k`` rows of each at most): without the query's own id these hold every row of the class that
can be among its best.  Bounds and exact scores are worked out once for a class, however
many rows share it.

Classes lie in blocks of ``block`` and queries in blocks of ``query_block``
(as one packed row each), and each pair of blocks is one row of work, formed and used in
one pass: no product of both sides is shuffled or written.  The best bounds and scores of a query are
cut to the rows that count in every task before they meet; all its candidates never do.

Rows with a null id take no part; neither do null vectors nor vectors that hold
null or non-finite components.  Shorter vectors count as padded with zeros.  Each
row that asks is a query of its own, also if its id repeats; rows that share
the query's id are not its candidates, and are candidates of others one by one.  Ties go to the smaller id.  Scores are exact whole
numbers at any size: 64-bit while no sum can exceed them, else 38 decimal digits.  Components
beyond 2**58 after scaling count as 2**58, and a score beyond 64 bits is ranked by its
value and shown as the largest (smallest) 64-bit number.  An empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

SCALE = 256
BITS = 6
BLOCK = 4_096
QUERY_BLOCK = 1_024
FIRST = 4  # times k
#: largest component after scaling: a sum of 1,000 products has 38 digits
MOST = 1 << 58


def _matrix(blobs, dims: int, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), dtype).reshape(-1, dims)


def _pack_blocks(rows: DataFrame, block_col: str, dims: int, low: np.ndarray, width: np.ndarray, exact: bool) -> DataFrame:
    """One row per block: ids, row numbers, and the cells (or the integers) of all vectors."""
    def run(table: pa.Table) -> pa.Table:
        lists = table["x"].combine_chunks()
        if isinstance(lists, pa.ChunkedArray):
            lists = pa.concat_arrays(lists.chunks)
        size = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        x = np.zeros((len(size), dims), np.int64)
        row = np.repeat(np.arange(len(size)), size)
        x[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
        data = x if exact else ((x - low) // width).astype(np.uint8)
        many = table["many"].to_numpy().astype(np.uint8)
        return pa.table({block_col: table[block_col].slice(0, 1),
                         "ids": pa.array([table["id"].to_numpy().astype(np.int64).tobytes()], pa.binary()),
                         "many": pa.array([many.tobytes()], pa.binary()),
                         "keys": pa.array([table["row"].to_numpy().astype(np.int64).tobytes()], pa.binary()),
                         "data": pa.array([data.tobytes()], pa.binary())})
    return rows.groupBy(block_col).applyInArrow(
        run, f"{block_col} int, ids binary, many binary, keys binary, data binary")


def _classes(rows: DataFrame, k: int) -> DataFrame:
    """(row, x, ids, id, many): distinct vectors with the smallest ids that have
    them; ``many``: more than one id has it (``id`` is the smallest)."""
    members = rows.groupBy("x", "id").agg(F.count(F.lit(1)).alias("n")) \
        .withColumn("_nth", F.row_number().over(Window.partitionBy("x").orderBy("id"))).where(F.col("_nth") <= k + 1)
    ids = F.flatten(F.transform("m", lambda m: F.array_repeat(m["id"], F.least(m["n"], F.lit(k)).cast("int"))))
    return members.groupBy("x").agg(F.sort_array(F.collect_list(F.struct("id", "n"))).alias("m")) \
        .select(F.monotonically_increasing_id().alias("row"), "x", ids.alias("ids"),
                F.col("m")[0]["id"].alias("id"), (F.size("m") > 1).alias("many"))


def search(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5,
           scale: int = SCALE, bits: int = BITS, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, id, score): the ``k`` best rows for each row that
    ``is_query`` marks, without the query's own."""
    if not 1 <= bits <= 8:
        raise ValueError("bits must lie between 1 and 8")
    v = F.col(f"`{vector_col}`")
    good = F.col(f"`{id_col}`").isNotNull() & v.isNotNull() & F.forall(v, lambda x: F.coalesce(
        x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    ints = F.transform(v, lambda x: F.floor(
        F.least(F.greatest(x.cast("double") * scale, F.lit(-float(MOST))), F.lit(float(MOST)))).cast("long"))
    rows = vectors.where(good).select(F.col(f"`{id_col}`").cast("long").alias("id"), ints.alias("x"),
                                      F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    size = rows.agg(F.max(F.size("x")).alias("d"), F.count(F.lit(1)).alias("n"),
                    F.count(F.when(F.col("asks"), 1)).alias("q"),
                    F.max(F.array_max(F.transform("x", F.abs))).alias("top")).first()
    if not size["q"] or not size["d"]:
        return _empty(vectors, id_col)
    dims, top = size["d"], size["top"]
    wide = dims * top * top >= 1 << 62
    # two numbers for each dimension
    limits = {r["p"]: r for r in rows.select(F.posexplode("x").alias("p", "c"))
              .groupBy("p").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).collect()}
    low = np.array([min(0, limits[p]["lo"]) for p in range(dims)], np.int64)
    high = np.array([max(0, limits[p]["hi"]) for p in range(dims)], np.int64)
    width = np.maximum(1, -(-(high - low + 1) // (1 << bits)))
    classes = materialize(_classes(rows, k), "classes")
    blocks, query_blocks = -(-classes.count() // block), -(-size["q"] // query_block)

    # a class's and a query's key is its row number
    cells = _pack_blocks(classes.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")), "block",
                         dims, low, width, False)
    cells = materialize(cells.repartition(max(1, min(blocks, 4096)), "block"), "cells")
    asks = materialize(rows.where("asks").withColumn("many", F.lit(False)).withColumn(
        "qblock", F.pmod(F.xxhash64("row"), F.lit(query_blocks)).cast("int")), "asks")
    asked = materialize(_pack_blocks(asks, "qblock", dims, low, width, True), "asked") \
        .select("qblock", F.col("ids").alias("qids"), F.col("keys").alias("qkeys"), F.col("data").alias("queries"))

    def bounds(r):
        """(query keys, class keys, lower bounds, upper bounds), queries in rows."""
        q = _matrix([r["queries"]], dims, np.int64).astype(np.float64)
        c = _matrix([r["data"]], dims, np.uint8).astype(np.float64) * width + low
        base = q @ c.T
        reach = (width - 1).astype(np.float64)
        under = np.minimum(q, 0) @ reach
        over = np.maximum(q, 0) @ reach
        slack = 1 + 1e-9 * float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * dims
        qi, vi = np.frombuffer(r["qids"], np.int64), np.frombuffer(r["ids"], np.int64)
        lower, upper = base + (under - slack)[:, None], base + (over + slack)[:, None]
        own = (qi[:, None] == vi[None, :]) & (np.frombuffer(r["many"], np.uint8) == 0)
        lower[own] = -np.inf
        upper[own] = -np.inf
        return np.frombuffer(r["qkeys"], np.int64), np.frombuffer(r["keys"], np.int64), lower, upper

    def lows(batches):
        for batch in batches:
            for r in batch.to_pylist():
                qi, _, lower, _ = bounds(r)
                m = min(k, lower.shape[1])
                best = -np.partition(-lower, m - 1, axis=1)[:, :m]
                at, _ = np.nonzero(np.isfinite(best))
                yield pa.RecordBatch.from_arrays([pa.array(qi[at]), pa.array(best[np.isfinite(best)])], ["q", "low"])

    w = Window.partitionBy("q").orderBy(F.desc("low"))
    kth = cells.crossJoin(asked).mapInArrow(lows, "q long, low double") \
        .withColumn("r", F.row_number().over(w)).where(F.col("r") <= k) \
        .groupBy("q").agg(F.when(F.count(F.lit(1)) == k, F.min("low")).otherwise(F.lit(float("-inf"))).alias("kth"))
    need = asks.select("qblock", F.col("row").alias("q")).join(kth, "q", "left").groupBy("qblock").agg(
        F.sort_array(F.collect_list(F.struct("q", F.coalesce("kth", F.lit(float("-inf"))).alias("kth")))).alias("need"))
    asked = materialize(asked.join(need, "qblock"), "asked")

    def candidates(batches):
        for batch in batches:
            for r in batch.to_pylist():
                qi, vi, _, upper = bounds(r)
                need = {x["q"]: x["kth"] for x in r["need"]}
                a, b = np.nonzero((upper >= np.array([need[x] for x in qi.tolist()])[:, None]) & np.isfinite(upper))
                yield pa.RecordBatch.from_arrays([pa.array(qi[a]), pa.array(vi[b]), pa.array(upper[a, b])], ["q", "v", "up"])

    found = materialize(cells.crossJoin(asked).mapInArrow(candidates, "q long, v long, up double"), "candidates")
    exact = classes.select(F.col("row").alias("v"), F.col("x").alias("vx"), "ids")
    asks = asks.select(F.col("row").alias("q"), F.col("id").alias("query_id"), F.col("x").alias("qx"))

    def read(some: DataFrame) -> DataFrame:
        """The k best rows of each query among these classes."""
        kind = "decimal(38,0)" if wide else "long"
        whole = "decimal(19,0)" if wide else "long"
        product = F.aggregate(F.zip_with("qx", "vx", lambda a, b: F.coalesce(
            (a.cast(whole) * b.cast(whole)).cast(kind), F.lit(0).cast(kind))),
            F.lit(0).cast(kind), lambda s, x: (s + x).cast(kind))
        others = F.slice(F.filter("ids", lambda x: x != F.col("query_id")), 1, k)
        best = Window.partitionBy("q").orderBy(F.desc("score"), "id")
        return some.select("q", "v").join(exact, "v").join(asks, "q") \
            .select("q", "query_id", product.alias("score"), F.explode(others).alias("id")) \
            .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    order = Window.partitionBy("q").orderBy(F.desc("up"), "v")
    head = found.withColumn("o", F.row_number().over(order)).where(F.col("o") <= FIRST * k)
    sure = read(head).where(F.col("rank") == k).select("q", F.col("score").alias("kth"))
    rest = found.join(sure, "q", "left").where(F.col("kth").isNull() | (F.col("up") >= F.col("kth").cast("double")))
    return read(rest).select("query_id", "rank", F.col("id").alias(id_col), _shown(F.col("score"), wide).alias("score"))


def _shown(score: Column, wide: bool) -> Column:
    if not wide:
        return score
    edge = F.lit((1 << 63) - 1).cast("decimal(38,0)")
    return F.greatest(F.least(score, edge), -edge).cast("long")


def _empty(vectors: DataFrame, id_col: str) -> DataFrame:
    return vectors.where(F.lit(False)).select(
        F.lit(0).cast("long").alias("query_id"), F.lit(1).alias("rank"), F.lit(0).cast("long").alias(id_col),
        F.lit(0).cast("long").alias("score"))


def op4_va_search(spark, sf_dir: str) -> DataFrame:
    """The five best other vectors of every vector whose id divides by 50."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(vectors, F.col("vec_id") % 50 == 0)
