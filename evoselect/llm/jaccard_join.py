"""N-gram Jaccard join by vertical partitioning (operator 10).

A document's set is its distinct ``width``-word shingles (its whole word
sequence if it has fewer words), of lower-cased words.  Two documents link
when ``|x & y| / |x | y| >= share``, decided in whole numbers.

1. Packed counts (``exchange.py``) give every shingle its level, the logarithm
   of how often it occurs.  (level, hash) is the global n-gram order, rare
   ones first.  A document that holds fewer than ``share`` of its shingles in
   common with anything can link with nothing and leaves here.
2. Equal sets become one class; classes go on, copies don't.
3. Two sets that link share one of their first ``n - ceil(share n) + 1``
   shingles.  Among the classes that share one, the class that has most in
   common with others leads, and only (leader, other) pairs are tested, so a
   group of any size gives as many pairs as it has members.
4. Each pair's overlap is counted by vertical partitioning: pivots cut the
   global order into fragments, every class's set is cut into segments by
   them, each fragment counts the overlap of the two segments, and the counts
   are summed per pair.
5. Links join classes to components.  What is left are pairs that share a
   first shingle and lie in different components; all of these (and no pair
   inside one component) are tested the same way, so no link is lost.

Pairs pass only if their sizes, and the places of the shared shingle in both
sets, leave room for enough overlap.  Null texts, empty texts and texts
without a word have an empty set and link with nothing.  Rows that repeat are
copies.  Null ids take part; they are never the smallest id unless a component
has no other (then the component's id is null).  64-bit hashes stand for
shingles, 128 bits for whole sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from . import exchange as X
from .components import connected_components
from .words import Words, hash_words, mix, shingle_hashes, split_words

SHINGLE = 5
SHARE = 80
HEAVY = 2_000
FRAGMENTS = 8
_OTHER = np.uint64(0xD6E8FEB86659FD93)
_DOCS = 1 << 16


def shingle_sets(w: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(doc, hash) of the distinct shingles of every text, by doc."""
    h = hash_words(w)
    counts = w.counts
    place = np.arange(len(h)) - np.repeat(w.first[:-1], counts)
    doc = w.doc()
    full = np.flatnonzero(place + width <= np.repeat(counts, counts))
    sh, of = shingle_hashes(h, width)[full], doc[full]
    for n in range(1, width):  # texts of n words: the whole sequence
        few = np.flatnonzero(counts == n)
        if len(few):
            part = shingle_hashes(h, n)[w.first[few]]
            sh = np.concatenate([sh, mix(part + np.uint64(n))])
            of = np.concatenate([of, few])
    docs, hashes = [], []
    for low in range(0, max(1, len(counts)), _DOCS):
        here = slice(None) if len(counts) <= _DOCS else (of >= low) & (of < low + _DOCS)
        s, d = sh[here], of[here]
        order = np.argsort(((d - low).astype(np.uint64) << np.uint64(48)) | (s >> np.uint64(16)), kind="stable")
        s, d = s[order], d[order]
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1]) | (d[1:] != d[:-1])
        docs.append(d[new])
        hashes.append(s[new])
    return np.concatenate(docs), np.concatenate(hashes)


def _records(dealt: X.Dealt, text_col: str, carry: T.StructField, width: int, share: int) -> DataFrame:
    """(_row, _rid, n, fp1, fp2, shared): the set's size and fingerprint; for
    one row of each set in a chunk that can link, its common shingles in the
    global order."""
    buckets = dealt.buckets

    def sets(table: pa.Table):
        return shingle_sets(split_words(X.column(table, text_col), lower=True), width)

    def send(table: pa.Table) -> pa.Table:
        chunk = table["_chunk"][0].as_py()
        return X.pack(chunk, X.distinct(sets(table.sort_by("_rid"))[1], buckets))

    def receive(table: pa.Table, answer: pa.Table) -> pa.Table:
        table = table.sort_by("_rid")
        doc, h = sets(table)
        level = X.answer_of(answer)[0][X.distinct(h, buckets).inverse]
        first = np.searchsorted(doc, np.arange(table.num_rows + 1))
        n = np.diff(first)

        def sums(x: np.ndarray) -> np.ndarray:
            total = np.zeros(len(x) + 1, x.dtype)
            np.cumsum(x, out=total[1:])
            return total[first[1:]] - total[first[:-1]]

        fp1, fp2 = sums(mix(h)), sums(mix(h ^ _OTHER))
        common = sums((level > 0).astype(np.int64))
        can = (n > 0) & (common * 100 >= share * n)
        _, one = np.unique(np.stack([fp1, fp2], 1).view("V16").ravel(), return_index=True)
        new = np.zeros(len(n), bool)
        new[one] = True
        can &= new
        token = (np.minimum(level, 31).astype(np.int64) << 58) | (h >> np.uint64(6)).astype(np.int64)
        take = np.flatnonzero((level > 0) & can[doc])
        take = take[np.lexsort((token[take], doc[take]))]
        size = np.where(can, common, 0)
        shared = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()),
                                          pa.array(token[take]), mask=pa.array(~can))
        keep = table["_row"].combine_chunks()
        if isinstance(keep, pa.ChunkedArray):
            keep = pa.concat_arrays(keep.chunks)
        if not carry_text:
            at = [k for k in range(keep.type.num_fields) if keep.type.field(k).name != text_col]
            keep = pa.StructArray.from_arrays([keep.field(k) for k in at], fields=[keep.type.field(k) for k in at])
        return pa.table({"_row": keep, "_rid": table["_rid"], "n": pa.array(n, pa.int64()),
                         "fp1": pa.array(fp1.view(np.int64)), "fp2": pa.array(fp2.view(np.int64)), "shared": shared})

    carry_text = text_col in carry.dataType.names
    schema = T.StructType([carry]).add("_rid", "long").add("n", "long").add("fp1", "long").add("fp2", "long") \
        .add("shared", T.ArrayType(T.LongType()))
    groups = dealt.rows.groupBy("_chunk")
    levels = X.count_buckets(groups.applyInArrow(send, X.PACKED), dealt)
    return groups.cogroup(levels.groupBy("_chunk")).applyInArrow(receive, schema)


def _fits(a: str, b: str, share: int) -> str:
    """SQL: the sizes and the places of a shared shingle allow a link."""
    return (f"100 * least({a}.n, {b}.n) >= {share} * greatest({a}.n, {b}.n) AND "
            f"{100 + share} * least({a}.n - {a}.pos, {b}.n - {b}.pos) >= {share} * ({a}.n + {b}.n)")


def count_overlaps(pairs: DataFrame, sets: DataFrame, fragments: int = FRAGMENTS) -> DataFrame:
    """(x, y, overlap) for ``pairs`` (x, y) of ``sets`` (node, shared)."""
    if fragments > 1:
        marks = F.array(*[F.element_at("shared", F.greatest(F.lit(1), (F.size("shared") * k / fragments).cast("int")))
                          for k in range(1, fragments)])
        cuts = sets.select(F.explode(marks).alias("t")) \
            .agg(F.percentile_approx("t", [k / fragments for k in range(1, fragments)], 1000).alias("p")).first()["p"]
    pivots = [None, *sorted(set(cuts or [])), None] if fragments > 1 else [None, None]

    def within(lo, hi):
        return lambda t: (F.lit(True) if lo is None else t >= lo) & (F.lit(True) if hi is None else t < hi)

    segments = sets.select("node", F.posexplode(F.array(*[
        F.filter("shared", within(lo, hi)) for lo, hi in zip(pivots, pivots[1:])])).alias("fragment", "segment")) \
        .where(F.size("segment") > 0)
    x = segments.select(F.col("node").alias("x"), "fragment", F.col("segment").alias("xs"))
    y = segments.select(F.col("node").alias("y"), "fragment", F.col("segment").alias("ys"))
    return pairs.select("x", "y").join(x, "x").join(y, ["y", "fragment"]) \
        .select("x", "y", F.size(F.array_intersect("xs", "ys")).alias("part")) \
        .groupBy("x", "y").agg(F.sum("part").alias("overlap"))


def _links(pairs: DataFrame, sets: DataFrame, share: int, fragments: int) -> DataFrame:
    size = sets.select("node", "n")
    return count_overlaps(pairs, sets, fragments) \
        .join(size.select(F.col("node").alias("x"), F.col("n").alias("nx")), "x") \
        .join(size.select(F.col("node").alias("y"), F.col("n").alias("ny")), "y") \
        .where(F.col("overlap") * 100 >= (F.col("nx") + F.col("ny") - F.col("overlap")) * share).select("x", "y")


def _class_components(sets: DataFrame, share: int, fragments: int) -> DataFrame:
    """(node, comp) of the classes that link with another."""
    first = F.col("n") - F.ceil(F.col("n") * share / 100) + 1 - (F.col("n") - F.size("shared"))
    places = sets.withColumn("rare", (F.col("n") - F.size("shared")) / F.col("n")) \
        .withColumn("plain", -F.aggregate("shared", F.lit(0).cast("long"), lambda a, t: a + F.shiftright(t, 58))
                    / F.size("shared")) \
        .select("node", "n", "rare", "plain",
                F.posexplode(F.slice("shared", F.lit(1), first.cast("int"))).alias("k", "tok"),
                (F.col("n") - F.size("shared")).alias("before")) \
        .select("tok", "node", "n", "rare", "plain", (F.col("before") + F.col("k")).alias("pos"))
    heads = places.groupBy("tok").agg(F.min(F.struct("rare", "plain", "node", "n", "pos")).alias("h"),
                                      F.count(F.lit(1)).alias("members")).where("members > 1") \
        .select("tok", "h.node", "h.n", "h.pos")
    places = places.select("tok", "node", "n", "pos")
    pairs = materialize(
        heads.alias("a").join(places.alias("b"), F.expr(f"a.tok = b.tok AND a.node <> b.node AND {_fits('a', 'b', share)}"))
        .select(F.least("a.node", "b.node").alias("x"), F.greatest("a.node", "b.node").alias("y")).distinct(), "pairs")
    links = materialize(_links(pairs, sets, share, fragments), "links")
    comps = materialize(connected_components(links), "components")

    # the rest: pairs that share a first shingle across components
    put = places.join(heads.select("tok"), "tok", "left_semi").join(comps, "node", "left") \
        .select("tok", "node", "n", "pos", F.coalesce("comp", "node").alias("comp"))
    sizes = put.groupBy("tok", "comp").agg(F.count(F.lit(1)).alias("c")) \
        .groupBy("tok").agg(F.max(F.struct("c", "comp"))["comp"].alias("main"), F.count(F.lit(1)).alias("k")) \
        .where("k > 1").select("tok", "main")
    mixed = materialize(put.join(sizes, "tok"), "mixed")
    rest = mixed.where("comp <> main").alias("a").join(
        mixed.alias("b"), F.expr("a.tok = b.tok AND a.comp <> b.comp AND (b.comp = b.main OR a.node < b.node) AND "
                                 + _fits("a", "b", share))) \
        .select(F.least("a.node", "b.node").alias("x"), F.greatest("a.node", "b.node").alias("y")).distinct() \
        .join(pairs, ["x", "y"], "left_anti")
    rest = materialize(rest, "rest")
    more = materialize(_links(rest, sets, share, fragments), "links")
    if more.isEmpty():
        return comps
    star = comps.select(F.col("node").alias("x"), F.col("comp").alias("y")).where("x <> y")
    return connected_components(star.union(more))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None,
                    width: int = SHINGLE, share: int = SHARE, fragments: int = FRAGMENTS,
                    chunk_bytes: int = X.CHUNK_BYTES) -> DataFrame:
    """One row per row of ``docs``: the columns ``carry`` (default: the id),
    ``n_shingles``, ``component_id`` (smallest id that links reach) and
    ``keeper`` (true for one row of each component, and for rows without a
    word).  Carried columns of these three names are replaced.  ``share`` is in
    percent."""
    carry = [c for c in carry or [id_col] if c not in ("n_shingles", "component_id", "keeper")]
    use = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*carry, id_col, text_col])])
    dealt = X.deal(use, text_col, chunk_bytes)
    field = T.StructField("_row", T.StructType([f for f in use.schema if f.name != text_col or text_col in carry]), False)
    rows = materialize(_records(dealt, text_col, field, width, share), "records")
    key = ["fp1", "fp2", "n"]
    ident = F.col("_row").getField(id_col)
    classes = materialize(
        rows.where("n > 0").groupBy(*key).agg(
            F.min(F.struct(ident.isNull().alias("none"), ident.alias("id"), F.col("_rid").alias("rid"))).alias("least"),
            F.min(F.when(F.col("shared").isNotNull(), F.col("_rid"))).alias("node")), "classes")
    sets = materialize(rows.where("shared IS NOT NULL").select(F.col("_rid").alias("node"), "n", "shared")
                       .join(classes.select("node").where("node IS NOT NULL"), "node", "left_semi"), "sets")
    comps = _class_components(sets, share, fragments)
    named = materialize(classes.join(comps, "node", "left"), "named")
    best = materialize(named.where("comp IS NOT NULL").groupBy("comp").agg(
        F.min("least").alias("best"), F.count(F.lit(1)).alias("members")), "best")
    total = best.agg(F.coalesce(F.sum("members"), F.lit(0)).alias("n")).first()["n"]
    # components of more than one in ``HEAVY`` classes (fewer than HEAVY of them) go to the classes
    often = F.col("members") * HEAVY > total
    many = F.broadcast(best.where(often).select("comp", "best"))
    linked = named.where("comp IS NOT NULL")
    named = linked.join(many, "comp").select(*key, "best") \
        .unionByName(linked.join(many.select("comp"), "comp", "left_anti")
                     .join(best.where(~often).select("comp", "best"), "comp").select(*key, "best")) \
        .unionByName(named.where("comp IS NULL").select(*key, F.col("least").alias("best")))
    got = rows.drop("shared").join(named, key, "left")
    return got.select(*[F.col("_row").getField(c).alias(c) for c in carry], F.col("n").alias("n_shingles"),
                      F.when(F.col("n") > 0, F.col("best.id")).otherwise(ident).alias("component_id"),
                      F.coalesce(F.col("best.rid") == F.col("_rid"), F.lit(True)).alias("keeper"))


def op10_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """One row per document: set size and component."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", "n_shingles", "component_id")
