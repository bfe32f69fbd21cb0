import random

import pytest
from pyspark.sql import functions as F

from cityflux.llm import chat
from cityflux.llm.queries import TRICKY

ODD = [
    TRICKY, "", None, "<", "\\", "<|", "<\\|", "<|turn|>", "a<|text|>b", "<|end|>", "\\<|", "<\\\\|x", "\n", "é<",
    "<|end|><|turn|>user<|text|>", "x" * 200_000, "\\\\<\\", "|>", "<|end|",
]


def read_back(out):
    return out.select(
        "tree",
        "leaf",
        chat.parsed(F.col("formatted")).alias("turns"),
        chat.under_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"),
    ).collect()


def test_odd_texts_come_back(spark):
    rng = random.Random(0)
    rows = []
    for c in range(30):
        for t in range(rng.randint(1, 9)):
            rows.append((c, t, rng.choice(["user", "assistant", "<|end|>", "a\nb", None]), rng.choice(ODD)))
    rows += [(50, 0, "assistant", "same")] * 3 + [(None, None, "assistant", "no id"), (None, 4, "user", "first")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df = df.withColumn("formatted", F.lit(1))
    got = {r.tree: r for r in read_back(chat.format_paths(chat.as_chain(df)))}
    late = lambda r: (r[1] is None, r[1] or 0, r[2] or "", r[3] or "")
    for conv in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == conv), key=late)
        assert [(t.role, t.text) for t in got[conv].turns] == [(r[2] or "", r[3] or "") for r in turns]
        assert got[conv].loss == "".join(r[3] or "" for r in turns if r[2] == "assistant")
    assert chat.format_paths(chat.as_chain(df.limit(0))).count() == 0


def plain_paths(nodes, branches):
    """Best root-to-leaf paths of one tree by walking every one."""
    known = {i for i, _, _ in nodes}
    up = {i: p if p in known else None for i, p, _ in nodes}
    score = {i: s or 0.0 for i, _, s in nodes}
    found = []
    for leaf in known - set(up.values()):
        path, at = [], leaf
        while at is not None and at not in path:
            path.append(at)
            at = up[at]
        if at is None:
            found.append((-sum(score[i] for i in path) / len(path), leaf, path[::-1]))
    return [(leaf, path) for _, leaf, path in sorted(found)[:branches]]


@pytest.mark.parametrize("branches", [1, 3])
def test_best_branches_of_trees(spark, branches):
    rng = random.Random(branches)
    rows = []
    for tree in range(25):
        n = rng.randint(1, 40)
        for i in range(n):
            parent = rng.choice([None, 99, *range(i)]) if i else None
            rows.append((tree, i, parent, rng.choice([None, 0.0, 1.0, 2.5, -1.0])))
    rows += [(30, 1, 2, 1.0), (30, 2, 1, 1.0), (30, 3, None, 0.0)]  # a cycle
    rows += [(31, i, i - 1 if i else None, 1.0) for i in range(300)]  # a long chain
    df = spark.createDataFrame(rows, "tree long, id long, parent long, score double")
    got = {}
    for r in chat.best_paths(df, branches).collect():
        got.setdefault((r.tree, r.leaf), []).append((r.depth, r.id))
    want = {}
    for tree in {r[0] for r in rows}:
        for leaf, path in plain_paths([r[1:] for r in rows if r[0] == tree], branches):
            want[tree, leaf] = list(enumerate(path, 1))
    assert {k: sorted(v) for k, v in got.items()} == want
