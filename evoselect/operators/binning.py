"""Feature binning (the 32 bins of ML1): equal width, by quantiles, or by the
strides that ``pyspark.ml``'s tree picks its thresholds with.

Quantile bins take their borders from the feature's distribution, which is
what the reference's tree does with 32 bins: border i is the training value of
rank ceil(i n / 32), and a value's bin is the number of borders below it.
Ranks are exact at every size: values are counted, ranges of them are summed,
and running counts within a range are made only where a border lies, so no task
sorts a feature with more than about ``RANGE_VALUES`` distinct values.

Bounds are the per-feature min/max over training rows.  They are the only
thing brought to the driver: 2 numbers per feature, bounded by the schema
width, never by the row count (the same way MLlib ships its split
candidates).  The bin expression itself is a built-in ``transform`` over the
feature array.

Bounds are taken over finite values.  -inf lies in the first bin, +inf in the
last, and NULL and NaN get a bin of their own after it (number ``n_bins``), so
one odd value changes no other row's bin.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from ..sources.datasets import LabeledTable


@dataclass(frozen=True)
class BinSpec:
    lo: tuple[float, ...]
    hi: tuple[float, ...]
    n_bins: int = 32
    rows: int = 0                                          # training rows, nearly (for the number of tasks)
    cuts: tuple[tuple[float, ...], ...] | None = None      # quantile borders, by feature


#: features up to which an expression is written out for each one (compiled, no row is exploded)
FEW_FEATURES = 32


def feature_bounds(table: LabeledTable) -> DataFrame:
    """(f, lo, hi, n) over finite values of training rows; one partial+final aggregate."""
    train = table.df.where(~F.col("is_test"))
    if 0 < table.n_features <= FEW_FEATURES:
        aggs = []
        for i in range(table.n_features):
            x = F.get("features", F.lit(i))
            x = F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)
            aggs.append(F.struct(F.lit(i).alias("f"), F.min(x).alias("lo"), F.max(x).alias("hi"), F.count(x).alias("n")))
        return train.agg(F.array(*aggs).alias("a")).select(F.inline("a")).where("n > 0")
    long = train.select(F.posexplode("features").alias("f", "x"))
    return long.where(~F.isnan("x") & (F.abs("x") < float("inf"))).groupBy("f").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count(F.lit(1)).alias("n"))


def fit_bins(table: LabeledTable, n_bins: int = 32) -> BinSpec:
    rows = feature_bounds(table).collect()          # n_features rows
    by_f = {r["f"]: (r["lo"], r["hi"]) for r in rows}
    lo = tuple(float(by_f.get(i, (0.0, 0.0))[0] or 0.0) for i in range(table.n_features))
    hi = tuple(float(by_f.get(i, (0.0, 0.0))[1] or 0.0) for i in range(table.n_features))
    return BinSpec(lo, hi, n_bins, max((r["n"] for r in rows), default=0))


#: distinct values that a range of a feature has at most, nearly
RANGE_VALUES = 1_000_000


def _counted(table: LabeledTable, range_values: int) -> tuple[DataFrame, int, int]:
    """(f, x, n, r): training values with their counts, in ranges ``r`` of at most
    about ``range_values`` distinct values; the number of ranges; the most rows
    that a feature has."""
    long = table.df.where(~F.col("is_test")).select(F.posexplode("features").alias("f", "x"))
    # -0.0 and 0.0 are one value
    values = materialize(long.where(~F.isnan("x") & (F.abs("x") < float("inf")))
                         .groupBy("f", (F.col("x") + 0.0).alias("x")).agg(F.count(F.lit(1)).alias("n")), "values")
    size = values.groupBy("f").agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("n")).agg(F.max("v"), F.max("n")).first()
    ranges = max(1, -(-(size[0] or 0) // range_values))
    if ranges == 1:
        return values.withColumn("r", F.lit(0)), 1, size[1] or 0
    # approximate edges make ranges of like size; the borders don't depend on them
    edges = values.groupBy("f").agg(
        F.percentile_approx("x", [k / ranges for k in range(1, ranges)], 10 * ranges).alias("edges"))
    return materialize(values.join(edges, "f").select(
        "f", "x", "n", F.size(F.filter("edges", lambda e: e < F.col("x"))).alias("r")), "ranges"), ranges, size[1] or 0


def fit_quantile_bins(table: LabeledTable, n_bins: int = 32, range_values: int = RANGE_VALUES) -> BinSpec:
    values, _, rows = _counted(table, range_values)

    def borders(upto):
        """How many of the borders lie in the first ``upto`` values: rank ceil(i n / n_bins) <= upto."""
        return F.least(F.call_function("div", upto * n_bins, F.col("total")).cast("int"), F.lit(n_bins - 1))

    sums = values.groupBy("f", "r").agg(F.sum("n").alias("m"))
    sums = sums.withColumn("before", F.sum("m").over(Window.partitionBy("f").orderBy("r")) - F.col("m")) \
        .withColumn("total", F.sum("m").over(Window.partitionBy("f"))) \
        .where(borders(F.col("before") + F.col("m")) > borders(F.col("before")))
    upto = F.col("before") + F.sum("n").over(Window.partitionBy("f", "r").orderBy("x"))
    found = values.join(sums, ["f", "r"]).withColumn("upto", upto) \
        .withColumn("times", borders(F.col("upto")) - borders(F.col("upto") - F.col("n"))).where("times > 0")
    by_f: dict[int, list[float]] = {}
    for r in found.select("f", "x", "times").collect():      # n_bins - 1 numbers a feature at most
        by_f.setdefault(r["f"], []).extend([r["x"]] * r["times"])
    cuts = tuple(tuple(sorted(by_f.get(i, ()))) for i in range(table.n_features))
    return BinSpec((), (), n_bins, rows, cuts)


def fit_stride_bins(table: LabeledTable, n_bins: int = 32, range_values: int = RANGE_VALUES) -> BinSpec:
    """Borders by the rule of ``pyspark.ml``'s tree, over all training rows.

    With at most ``n_bins`` distinct values every midpoint of two neighbours is a
    border.  Otherwise the targets are the multiples of rows / n_bins.  The first
    value whose half-way count (rows before it plus half its own) is beyond a
    target ends that target's border, a midpoint with the value before it; a
    value ends one border at most, so a later target moves on to the next value.
    Hence target k ends at value max over j <= k of (first value beyond target j)
    + k - j.  Values are numbered by range, then within it, and only the values
    that end a border are looked up."""
    values, _, rows = _counted(table, range_values)
    sums = values.groupBy("f", "r").agg(F.sum("n").alias("m"), F.count(F.lit(1)).alias("v"))
    by_f, by_r = Window.partitionBy("f"), Window.partitionBy("f").orderBy("r")
    sums = sums.select("f", "r", (F.sum("m").over(by_r) - F.col("m")).alias("rows_before"),
                       (F.sum("v").over(by_r) - F.col("v")).alias("values_before"),
                       F.sum("m").over(by_f).alias("total"), F.sum("v").over(by_f).alias("distinct"))
    in_range = Window.partitionBy("f", "r").orderBy("x")
    placed = values.join(sums, ["f", "r"]).select(
        "f", "x", "distinct", (F.col("values_before") + F.row_number().over(in_range) - 1).alias("place"),
        # half-way count and targets in units of rows / (2 n_bins)
        ((F.lit(2) * (F.col("rows_before") + F.sum("n").over(in_range)) - F.col("n")) * n_bins).alias("half"),
        (F.col("total") * 2).alias("stride"))
    placed = materialize(placed, "placed")
    few = F.col("distinct") <= n_bins
    # the first value beyond each target, in its range and then of all
    last = F.least(F.call_function("div", F.col("half") - 1, F.col("stride")), F.col("distinct") + n_bins).cast("int")
    firsts = placed.where(~few & (F.col("place") > 0) & (F.col("half") > F.col("stride"))) \
        .groupBy("f", last.alias("k")).agg(F.min("place").alias("place")).collect()      # about n_bins a feature
    ends: dict[int, set[int]] = {}
    seen: dict[int, dict[int, int]] = {}
    for r in firsts:
        seen.setdefault(r["f"], {})[r["k"]] = r["place"]
    for f, beyond in seen.items():
        at, top = -1, max(beyond)
        reach = {}
        for k in range(top, 0, -1):          # a value beyond target k + 1 is beyond target k
            reach[k] = min(beyond.get(k, 1 << 62), reach.get(k + 1, 1 << 62))
        for k in range(1, top + 1):
            at = max(at + 1, reach[k])
            ends.setdefault(f, set()).add(at)
    wanted = table.df.sparkSession.createDataFrame(
        [(f, p + d) for f, places in ends.items() for p in places for d in (-1, 0)] or [(-1, -1)], "f int, place long").distinct()
    got = placed.where(few).select("f", "place", "x").unionByName(
        placed.where(~few).join(wanted, ["f", "place"]).select("f", "place", "x")).collect()   # 2 n_bins a feature at most
    by_place: dict[int, dict[int, float]] = {}
    for r in got:
        by_place.setdefault(r["f"], {})[r["place"]] = r["x"]
    cuts = []
    for f in range(table.n_features):
        x = by_place.get(f, {})
        places = sorted(ends.get(f, [p for p in x if p]))
        cuts.append(tuple((x[p - 1] + x[p]) / 2 for p in places if p in x and p - 1 in x))
    return BinSpec((), (), n_bins, rows, tuple(cuts))


def bin_features(features: Column, spec: BinSpec) -> Column:
    """bin = clamp(floor((x - lo) / (hi - lo) * n_bins), 0, n_bins - 1); values
    of a constant feature go to bin 0, missing ones (NULL, NaN) to bin ``n_bins``."""
    nb = F.lit(spec.n_bins)
    if spec.cuts is not None:
        cuts = F.array(*[F.lit(list(c)) if c else F.array().cast("array<double>") for c in spec.cuts])
        return F.transform(features, lambda x, i: F.when(x.isNull() | F.isnan(x), nb).otherwise(
            F.size(F.filter(F.element_at(cuts, i + 1), lambda c: c < x))).cast("int"))
    lo = F.lit(list(spec.lo))
    hi = F.lit(list(spec.hi))

    def one(x, i):
        a = F.element_at(lo, i + 1)
        b = F.element_at(hi, i + 1)
        raw = F.floor((F.least(F.greatest(x, a), b) - a) / (b - a) * nb)
        binned = F.least(F.greatest(raw, F.lit(0)), nb - 1)
        return F.when(x.isNull() | F.isnan(x), nb).when(b > a, binned).otherwise(F.lit(0)).cast("int")

    every = F.transform(features, one)
    n = len(spec.lo)
    if not 0 < n <= FEW_FEATURES:
        return every

    def known(i):
        x, a, b = F.get(features, F.lit(i)), spec.lo[i], spec.hi[i]
        raw = F.floor((F.least(F.greatest(x, F.lit(a)), F.lit(b)) - F.lit(a)) / F.lit(b - a) * nb) if b > a else F.lit(0)
        return F.when(x.isNull() | F.isnan(x), nb).otherwise(F.least(F.greatest(raw, F.lit(0)), nb - 1)).cast("int")

    size = F.size(features)
    return F.when(features.isNotNull() & (size <= n), F.slice(F.array(*[known(i) for i in range(n)]), F.lit(1), size)) \
        .otherwise(every)


def binned_rows(table: LabeledTable, spec: BinSpec) -> DataFrame:
    """(y, is_test, bins array<int>) -- the compact form every pass reads."""
    return table.df.select(
        F.col("label").alias("y"),
        F.col("is_test"),
        bin_features(F.col("features"), spec).alias("bins"),
    )
