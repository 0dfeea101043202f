"""URL filters with a character language-model ratio (operator 8), as
DataFrame operations only.

Rules come first: a rule (verdict, host, path) fits its host and all
subdomains if the URL's path starts with the rule's; the longest fitting rule
decides.  URLs that no rule fits are judged by two character models, of the
URLs that rules accept and of those they reject (host and path): variable-order
Markov models, interpolated over all context lengths up to ``order`` by
Witten-Bell smoothing,

    p_k(c | ctx) = (n(ctx c) + t(ctx) p_{k-1}(c | shorter ctx)) / (n(ctx) + t(ctx)),

with t(ctx) the number of different characters seen after ctx.  The score of a
URL is its mean log-probability under the first minus that under the second;
it is accepted at ``cut`` or more.  The models count all ruled URLs.  The cut
comes from models of all but one fold in five (by a hash of host and path): it
is where that fold's URLs are told apart best (mean of both classes' accuracy,
on scores rounded to 0.01, lowest cut first).  Each distinct (host, path) is
counted with its number of rows and scored once.

Grams with more than one in ``HEAVY`` of all places (so fewer than ``HEAVY`` of
them) meet the places in a broadcast join; no other gram is a large key of the
join of the rest.

A null URL, and one without ``://``, has empty host and path.  Rows that repeat
count and come out each.  If the rules accept nothing or reject nothing, there
is no ratio, and what no rule fits is allowed; if that holds without the fold
only, the cut is 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

ORDER = 4
FOLDS = 5
HEAVY = 2_000
BEGIN, END = "\x02", "\x03"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path)."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.coalesce(F.translate(raw, _UPPER, _UPPER.lower()), F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """(text, verdict) of the longest fitting rule; null without one."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        text = F.when(fits, F.lit(h + p)).otherwise(text)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return text, verdict


def _places(texts: DataFrame, order: int) -> DataFrame:
    """One row per character and end of ``text``: the character with the
    ``order`` characters before it."""
    padded = F.concat(F.lit(BEGIN * order), F.col("text"), F.lit(END))
    return texts.withColumn("_padded", padded) \
        .withColumn("_i", F.explode(F.sequence(F.lit(1), F.length("text") + 1))) \
        .withColumn("gram", F.substring(F.col("_padded"), F.col("_i"), order + 1)).drop("_padded", "_i")


def _suffixes(grams: DataFrame, order: int) -> DataFrame:
    """Each gram with all its suffixes: (.., k, part, context), k = context length."""
    return grams.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(order)))) \
        .withColumn("part", F.substring("gram", F.lit(order + 1) - F.col("k"), F.col("k") + 1)) \
        .withColumn("context", F.substring("part", F.lit(1), F.col("k")))


def fit_models(texts: DataFrame, order: int = ORDER) -> tuple[DataFrame, DataFrame]:
    """(counts, contexts) of ``texts`` (text, good, bad: numbers of rows).
    counts: part, k, good, bad.  contexts: context, n and t of both sides."""
    grams = _places(texts, order).groupBy("gram").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    counts = materialize(_suffixes(grams, order).groupBy("part", "context")
                         .agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")), "counts")
    contexts = counts.groupBy("context").agg(
        F.sum("good").alias("good_n"), F.count(F.when(F.col("good") > 0, 1)).alias("good_t"),
        F.sum("bad").alias("bad_n"), F.count(F.when(F.col("bad") > 0, 1)).alias("bad_t"))
    return counts.drop("context"), materialize(contexts, "contexts")


def score_texts(texts: DataFrame, models: tuple[DataFrame, DataFrame], order: int = ORDER,
                heavy: int = HEAVY) -> DataFrame:
    """(text, ratio): mean log-probability as good minus as bad."""
    counts, contexts = models
    places = _places(texts.select("text"), order)
    parts = _suffixes(places.groupBy("gram").agg(F.count(F.lit(1)).alias("times")), order) \
        .join(counts, "part", "left").join(contexts, "context", "left")
    levels = parts.groupBy("gram", "times").agg(F.sort_array(F.collect_list(F.struct(
        "k", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "good_n", "good_t", "bad", "bad_n", "bad_t")]
    ))).alias("levels"))

    def chance(side: str) -> Column:
        def up(p, x):
            n, t = x[f"{side}_n"], x[f"{side}_t"]
            return F.when(n > 0, (x[side] + t * p) / (n + t)).otherwise(p)
        return F.aggregate("levels", F.lit(1 / 256), up)

    gain = materialize(levels.select("gram", "times", (F.log(chance("good")) - F.log(chance("bad"))).alias("gain")), "gain")
    total = gain.agg(F.coalesce(F.sum("times"), F.lit(0)).alias("n")).first()["n"]
    often = F.col("times") * heavy > total  # fewer than ``heavy`` grams
    many = F.broadcast(gain.where(often).select("gram", "gain"))
    few = gain.where(~often).select("gram", "gain")
    met = places.join(many, "gram").select("text", "gain") \
        .unionByName(places.join(many.select("gram"), "gram", "left_anti").join(few, "gram").select("text", "gain"))
    return met.groupBy("text").agg(F.avg("gain").alias("ratio"))


def _cut(scored: DataFrame) -> float:
    """Where (ratio, good, bad) is told apart best; scores are bounded, so
    there are some hundred different rounded ones."""
    rows = sorted((r["at"], r["good"], r["bad"]) for r in scored.groupBy(F.round("ratio", 2).alias("at"))
                  .agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).collect())
    good, bad = sum(r[1] for r in rows), sum(r[2] for r in rows)
    if not good or not bad:
        return 0.0
    best, at, below_good, below_bad = -1.0, 0.0, 0, 0
    for cut, g, b in rows:
        told = (good - below_good) / good + below_bad / bad
        if told > best + 1e-12:
            best, at = told, cut
        below_good, below_bad = below_good + g, below_bad + b
    return at - 0.005


def filter_urls(pages: DataFrame, url_col: str = "url", rules=RULES, order: int = ORDER) -> DataFrame:
    """``pages`` with host, path, rule, verdict and ratio (null where a rule
    decides).  Columns of these names are replaced."""
    names = ("host", "path", "rule", "verdict", "ratio")
    url = F.col(f"`{url_col}`")
    host, path = url_parts(url)
    own = [F.col(f"`{c}`") for c in pages.columns if c not in names]
    ruled = pages.select(*own, host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = ruled.withColumn("rule", rule).withColumn("_ruled", verdict)
    texts = materialize(ruled.groupBy("host", "path", "_ruled").count().select(
        F.concat("host", "path").alias("text"), "host", "path",
        F.when(F.col("_ruled") == "allow", F.col("count")).otherwise(0).alias("good"),
        F.when(F.col("_ruled") == "block", F.col("count")).otherwise(0).alias("bad"),
        F.col("_ruled").isNotNull().alias("known"),
        (F.pmod(F.xxhash64("host", "path"), F.lit(FOLDS)) == 0).alias("kept_out")), "texts")
    known = texts.where("known")
    count = [F.sum("good").alias("g"), F.sum("bad").alias("b")]
    sides = known.agg(*count).first()
    if not sides["g"] or not sides["b"]:
        return ruled.withColumn("verdict", F.coalesce("_ruled", F.lit("allow"))) \
            .withColumn("ratio", F.lit(None).cast("double")).drop("_ruled")
    cut, rest, kept = 0.0, known.where("NOT kept_out"), known.where("kept_out")
    sides = rest.agg(*count).first()
    if sides["g"] and sides["b"]:
        cut = _cut(kept.join(score_texts(kept.select("text").distinct(), fit_models(rest, order), order), "text"))
    scores = materialize(score_texts(texts.where("NOT known").select("text").distinct(),
                                     fit_models(known, order), order), "scores")
    ratio = texts.where("NOT known").join(scores, "text").select("host", "path", "ratio")
    out = ruled.join(ratio, ["host", "path"], "left")
    decided = F.coalesce("_ruled", F.when(F.col("ratio") >= cut, F.lit("allow")).otherwise(F.lit("block")))
    return out.select(*own, "host", "path", "rule", decided.alias("verdict"),
                      F.when(F.col("_ruled").isNull(), F.col("ratio")).alias("ratio"))


def op8_url_filter(spark, sf_dir: str) -> DataFrame:
    """One row per page: its host, path, rule and verdict."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages).select("page_id", "host", "path", "rule", "verdict")
