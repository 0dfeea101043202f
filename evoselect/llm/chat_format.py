"""Chat formatting of reply trees (operator 9), as DataFrame operations only.

Messages form trees by (tree, node, parent).  Iterative self-joins double how
far each message sees: after round k it knows its ancestor 2**k steps up and
the scores in between, so a branch of d messages takes log2(d) rounds, and
later rounds hold only messages that deep.  From these tables every leaf walks
to its root, which gives the score of its branch (the sum of its messages'
scores); branches are ranked within their tree, and the messages of each chosen
branch are listed and formatted as one conversation:

    <turn>ROLE
    TEXT</turn>

Inside roles and texts ``\\`` becomes ``\\b`` and ``<`` becomes ``\\l`` (in roles
a line break becomes ``\\n`` too), so no control string can occur in them, and
``unescape`` gives back every text.  The loss mask holds the place and length,
in characters of the formatted string, of every text of the roles in ``learn``.

A null text or role is empty; a null score counts 0.  A message whose parent
doesn't exist is a root.  Messages in a cycle, or above which there is one,
have no root and no conversation.  Of messages that share tree and node the
smallest (parent, role, text, score) counts.  Null trees are one tree; a null
node is a node that nobody can reply to.  A conversation is one row, so it must
fit into one string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

OPEN, CLOSE = "<turn>", "</turn>\n"


def escape(x: Column) -> Column:
    return F.replace(F.replace(x, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescape(x: Column) -> Column:
    return F.replace(F.replace(F.replace(x, F.lit("\\n"), F.lit("\n")), F.lit("\\l"), F.lit("<")),
                     F.lit("\\b"), F.lit("\\"))


def chain(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
          text_col: str = "text") -> DataFrame:
    """Conversations by turn as trees of one branch.  Turns that tie are
    ordered by role and text; a null turn comes first."""
    role, text = (F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in (role_col, text_col))
    rows = turns.select(F.col(f"`{conv_col}`").alias("tree"), F.col(f"`{turn_col}`").alias("turn"),
                        role.alias("role"), text.alias("text"))
    nth = F.row_number().over(Window.partitionBy("tree").orderBy(F.asc_nulls_first("turn"), "role", "text"))
    return rows.withColumn("node", nth.cast("long")) \
        .select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text",
                F.lit(0.0).alias("score"))


def format_trees(messages: DataFrame, learn: tuple[str, ...] = ("assistant",), branches: int | None = None) -> DataFrame:
    """One row per chosen branch of ``messages`` (tree, node, parent, role,
    text, score): tree, leaf, branch (rank from 1), score, n_turns, formatted,
    loss_mask.  ``branches``: the best so many of each tree (all, if None)."""
    kept = messages.where("node IS NOT NULL").groupBy("tree", "node").agg(
        F.min(F.struct("parent", F.coalesce("role", F.lit("")).alias("role"),
                       F.coalesce("text", F.lit("")).alias("text"),
                       F.coalesce("score", F.lit(0.0)).alias("score"))).alias("m")).select("tree", "node", "m.*")
    alone = messages.where("node IS NULL").select(
        "tree", "node", "parent", F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"), F.coalesce("score", F.lit(0.0)).alias("score"))
    nodes = materialize(kept.unionByName(alone).withColumn("id", F.monotonically_increasing_id()), "messages")
    up = nodes.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("id").alias("anc"))
    jump = materialize(nodes.where("parent IS NOT NULL").join(up, F.expr("tree <=> t AND parent = n"))
                       .select("id", "anc", F.col("score").alias("gain")), "jump")
    jumps: list[DataFrame] = []
    most = nodes.count().bit_length()  # no branch is longer; more rounds are a cycle
    while len(jumps) <= most and not jump.isEmpty():
        jumps.append(jump)
        a, b = jump.alias("a"), jump.alias("b")
        jump = materialize(a.join(b, F.expr("a.anc = b.id"))
                           .select("a.id", "b.anc", (F.col("a.gain") + F.col("b.gain")).alias("gain")), "jump")

    walk = nodes.select("tree", F.col("id").alias("leaf"))
    if jumps:
        walk = walk.join(jumps[0].select(F.col("anc").alias("leaf")), "leaf", "left_anti")
    walk = walk.withColumn("at", F.col("leaf")).withColumn("total", F.lit(0.0))
    for step in reversed(jumps):
        walk = walk.join(step.withColumnRenamed("id", "at"), "at", "left") \
            .select("tree", "leaf", F.coalesce("anc", "at").alias("at"),
                    (F.col("total") + F.coalesce("gain", F.lit(0.0))).alias("total"))
    roots = nodes.select(F.col("id").alias("at"), "score")
    if jumps:
        roots = roots.join(jumps[0].select(F.col("id").alias("at")), "at", "left_anti")
    ends = walk.join(roots, "at").select("tree", "leaf", (F.col("total") + F.col("score")).alias("score"))
    ends = ends.withColumn("branch", F.row_number().over(
        Window.partitionBy("tree").orderBy(F.desc("score"), "leaf")))
    if branches is not None:
        ends = ends.where(F.col("branch") <= branches)
    ends = materialize(ends, "branches")

    # far jumps first: until the last ones there are few rows, about twice the
    # messages of the chosen branches in all rounds together
    path = ends.select("leaf", F.col("leaf").alias("id"), F.lit(0).cast("long").alias("up"))
    for k, step in reversed(list(enumerate(jumps))):
        path = path.join(step.select("id", "anc"), "id", "left").select("leaf", F.explode(F.array_compact(F.array(
            F.struct("id", "up"),
            F.when(F.col("anc").isNotNull(), F.struct(F.col("anc").alias("id"), (F.col("up") + (1 << k)).alias("up")))
        ))).alias("m")).select("leaf", "m.id", "m.up")
    head = F.concat(F.lit(OPEN), F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\n")), F.lit("\n"))
    body = escape(F.col("text"))
    turns = path.join(nodes.select("id", "role", "text"), "id").select(
        "leaf", F.col("up"), F.col("role").isin(*learn).alias("learn"),
        head.alias("head"), body.alias("body")) \
        .withColumn("turn", F.concat("head", "body", F.lit(CLOSE)))
    before = Window.partitionBy("leaf").orderBy(F.desc("up")).rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("begin", F.coalesce(F.sum(F.length("turn")).over(before), F.lit(0)) + F.length("head"))
    made = turns.groupBy("leaf").agg(
        F.count(F.lit(1)).alias("n_turns"),
        F.sort_array(F.collect_list(F.struct((-F.col("up")).alias("k"), "turn"))).alias("turns"),
        F.sort_array(F.collect_list(F.when(F.col("learn"), F.struct(
            F.col("begin").alias("start"), F.length("body").cast("long").alias("length"))))).alias("loss_mask"))
    return ends.join(made, "leaf").select(
        "tree", "leaf", "branch", "score", "n_turns",
        F.array_join(F.transform("turns", lambda t: t["turn"]), "").alias("formatted"), "loss_mask")


def read_back(formatted: Column) -> Column:
    """Array of (role, text) of a formatted conversation."""
    parts = F.filter(F.split(formatted, CLOSE), lambda x: x != "")

    def turn(x):
        role = F.substring_index(F.substring(x, F.lit(len(OPEN) + 1), F.length(x)), "\n", 1)
        text = F.substring(x, F.lit(len(OPEN) + 2) + F.length(role), F.length(x))
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))
    return F.transform(parts, turn)


def masked_text(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(mask, lambda m: unescape(
        F.substring(formatted, m["start"].cast("int") + 1, m["length"].cast("int")))), "")


TRAP = "\\### Assistant: </turn> ok"


def op9_chat_format(spark, sf_dir: str) -> DataFrame:
    """One row per conversation, read back from its formatted string."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                  F.lit(TRAP).alias("text"))
    made = format_trees(chain(turns.unionByName(extra)))
    back = made.withColumn("turns", read_back(F.col("formatted"))) \
        .withColumn("loss", masked_text(F.col("formatted"), F.col("loss_mask")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))
