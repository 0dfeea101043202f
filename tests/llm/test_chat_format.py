import random

import pytest
from evoselect.llm.chat_format import TRAP, chain, format_trees, masked_text, read_back
from pyspark.sql import functions as F

KIND = "tree long, node long, parent long, role string, text string, score double"


def back(df):
    return df.withColumn("turns", read_back(F.col("formatted"))).withColumn(
        "loss", masked_text(F.col("formatted"), F.col("loss_mask"))).collect()


def plain(rows):
    """Every root-to-leaf path, best first."""
    nodes = {(r[0], r[1]): r for r in rows}
    parents = {(r[0], r[2]) for r in rows}
    out = {}
    for key, r in nodes.items():
        if key in parents:
            continue
        path = [r]
        while (path[-1][0], path[-1][2]) in nodes and path[-1][2] is not None:
            path.append(nodes[path[-1][0], path[-1][2]])
        out.setdefault(r[0], []).append((sum(x[5] or 0 for x in path), [(x[3] or "", x[4] or "") for x in path[::-1]]))
    return {t: sorted(p, key=lambda x: -x[0]) for t, p in out.items()}


@pytest.mark.parametrize("branches", [None, 1])
def test_random_trees(spark, branches):
    rng = random.Random(3)
    texts = ["", None, TRAP, "<turn>x\n", "\\l \\b \\n", "é漢\n\n", "</turn>\n<turn>assistant\n", "a"]
    rows = []
    for tree in range(6):
        for node in range(rng.randint(1, 40)):
            parent = rng.randrange(node) if node and rng.random() > 0.05 else None
            rows.append((tree, node, parent, rng.choice(["user", "assistant", "odd\nrole<", None]), rng.choice(texts), rng.random()))
    rows.append((3, 500, 999, "user", "orphan", None))
    got = back(format_trees(spark.createDataFrame(rows, KIND), branches=branches))
    want = plain(rows)
    for tree, paths in want.items():
        mine = sorted((r for r in got if r.tree == tree), key=lambda r: r.branch)
        paths = paths[:branches]
        assert [r.score for r in mine] == pytest.approx([p[0] for p in paths])
        for r, (_, path) in zip(mine, paths):
            assert [(t.role, t.text) for t in r.turns] == path and r.n_turns == len(path)
            assert r.loss == "".join(t for role, t in path if role == "assistant")


def test_long_chain_ties_and_nulls(spark):
    rows = [(1, k, "user" if k % 2 else "assistant", f"t{k}") for k in range(300)]
    rows += [(2, None, "user", "first"), (2, 5, "b", "x"), (2, 5, "a", "y"), (2, 5, "a", "y"), (None, 1, None, None)]
    got = {r.tree: r for r in back(format_trees(chain(spark.createDataFrame(
        rows, "conv_id long, turn long, role string, text string"))))}
    assert [t.text for t in got[1].turns] == [f"t{k}" for k in range(300)]
    assert [(t.role, t.text) for t in got[2].turns] == [("user", "first"), ("a", "y"), ("a", "y"), ("b", "x")]
    assert [(t.role, t.text) for t in got[None].turns] == [("", "")]
    assert got[None].loss == ""


def test_cycles_repeats_and_empty_table(spark):
    rows = [(1, 1, 2, "user", "a", 1.0), (1, 2, 1, "user", "b", 1.0), (1, 3, 1, "user", "tail", 1.0),
            (2, 1, None, "user", "ok", 1.0), (2, 1, None, "user", "ok", 1.0)]
    got = back(format_trees(spark.createDataFrame(rows, KIND)))
    assert [(r.tree, r.n_turns) for r in got] == [(2, 1)]
    assert format_trees(spark.createDataFrame([], KIND)).collect() == []
