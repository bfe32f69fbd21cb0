"""Chat formatting of reply trees.

Messages form trees by their parent ids. Iterative self-joins with doubled steps give every
message its depth and the score of its path from the root, so a chain of a million replies
takes twenty rounds. Branches, one per leaf, are ranked by mean score, and each chosen path
is formatted as one conversation. Only ids and numbers take part in the joins; texts join
the chosen paths once.

Template: ``<|turn|>role<|text|>text<|end|>`` per turn. Inside roles and texts a backslash
is doubled and ``<|`` becomes ``<\\|``, so no control string can occur there and reading
back is exact. Only DataFrame and SQL functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .tables import stored

# Control strings of the template.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"


def escaped(x: Column) -> Column:
    doubled = F.replace(x, F.lit("\\"), F.lit("\\\\"))
    return F.replace(doubled, F.lit("<|"), F.lit("<\\|"))


def unescaped(x: Column) -> Column:
    plain = F.replace(x, F.lit("<\\|"), F.lit("<|"))
    return F.replace(plain, F.lit("\\\\"), F.lit("\\"))


def _rounds(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Tables tree, id, up, depth, total by round, and the finished rows.

    In table ``r`` a node's ``up`` is its ``2**r``-th ancestor; depth and total cover the
    nodes from it up to, but without, that ancestor. A node that has reached its root is
    finished: it is looked up by others but takes no further step, so the rounds of a few
    long chains cost what those chains hold.
    """
    largest = nodes.groupBy("tree").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    step = stored(nodes, "replies")
    tables, finished = [step.where("up is not null")], step.where("up is null")
    while (1 << len(tables) - 1) < largest and not tables[-1].isEmpty():
        near, far = tables[-1].alias("near"), tables[-1].unionByName(finished).alias("far")
        same = F.col("near.tree").eqNullSafe(F.col("far.tree")) & (F.col("near.up") == F.col("far.id"))
        step = near.join(far, same).select(
            "near.tree",
            "near.id",
            "far.up",
            (F.col("near.depth") + F.col("far.depth")).alias("depth"),
            (F.col("near.total") + F.col("far.total")).alias("total"),
        )
        step = stored(step, "replies")
        tables.append(step.where("up is not null"))
        finished = finished.unionByName(step.where("up is null"))
    return tables, finished


def best_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """tree, leaf, id, depth of the messages on the best branches of each tree.

    ``messages``: tree, id, parent, score; ids unique in their tree. A message whose parent
    is missing is a root. Branches rank by mean score (null scores are 0), then by the
    smaller leaf id. Messages in a cycle of parents are on no path.
    """
    parents = messages.select(F.col("tree").alias("t"), F.col("id").alias("known"))
    there = F.col("tree").eqNullSafe(F.col("t")) & (F.col("parent") == F.col("known"))
    nodes = messages.join(parents, there, "left").select(
        "tree",
        "id",
        F.col("known").alias("up"),
        F.lit(1).cast("long").alias("depth"),
        F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("total"),
    )
    rounds, done = _rounds(nodes)
    used = rounds[0].select(F.col("tree").alias("t"), F.col("up").alias("u"))
    leaves = done.join(used, F.col("tree").eqNullSafe(F.col("t")) & (F.col("id") == F.col("u")), "left_anti")
    best = Window.partitionBy("tree").orderBy(F.desc(F.col("total") / F.col("depth")), "id")
    chosen = leaves.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= branches)
    on_path = chosen.select("tree", F.col("id").alias("leaf"), "id")
    for table in reversed(rounds[:-1]):
        path, step = on_path.alias("p"), table.alias("s")
        same = F.col("p.tree").eqNullSafe(F.col("s.tree")) & (F.col("p.id") == F.col("s.id"))
        above = path.join(step, same).select("p.tree", "p.leaf", F.col("s.up").alias("id"))
        on_path = stored(on_path.unionByName(above), "path")
    at, deep = on_path.alias("p"), done.alias("d")
    same = F.col("p.tree").eqNullSafe(F.col("d.tree")) & (F.col("p.id") == F.col("d.id"))
    return at.join(deep, same).select("p.tree", "p.leaf", "p.id", "d.depth")


def format_paths(messages: DataFrame, branches: int = 1, learn: str = "assistant") -> DataFrame:
    """tree, leaf, formatted, loss_spans (start, length in code points of the escaped texts
    of role ``learn``), one row per chosen path.

    ``messages``: tree, id, parent, score, role, text; null roles and texts are empty. A
    conversation is one row, so it must fit into one.
    """
    paths = best_paths(messages.select("tree", "id", "parent", "score"), branches).alias("p")
    same = F.col("p.tree").eqNullSafe(F.col("m.tree")) & (F.col("p.id") == F.col("m.id"))
    turns = paths.join(messages.alias("m"), same).select(
        "p.tree",
        "p.leaf",
        "p.depth",
        F.coalesce("m.role", F.lit("")).alias("role"),
        escaped(F.coalesce("m.text", F.lit(""))).alias("body"),
    )
    head = F.concat(F.lit(TURN), escaped(F.col("role")), F.lit(TEXT))
    pieces = turns.select(
        "tree",
        "leaf",
        "depth",
        (F.col("role") == learn).alias("learn"),
        F.concat(head, "body", F.lit(END)).alias("piece"),
        F.char_length(head).cast("long").alias("before"),
        F.char_length("body").cast("long").alias("length"),
    )
    order = Window.partitionBy("tree", "leaf").orderBy("depth")
    so_far = F.sum(F.char_length("piece")).over(order) - F.char_length("piece")
    placed = pieces.withColumn("start", so_far + F.col("before"))
    turn = F.struct("depth", "piece", "learn", "start", "length")
    grouped = placed.groupBy("tree", "leaf").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    spans = F.transform(
        F.filter("turns", lambda t: t["learn"]),
        lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length")),
    )
    formatted = F.array_join(F.transform("turns", lambda t: t["piece"]), "")
    return grouped.select("tree", "leaf", formatted.alias("formatted"), spans.alias("loss_spans"))


def parsed(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation, read back."""
    turns = F.filter(F.split(formatted, r"<\|end\|>"), lambda t: t != "")
    return F.transform(
        turns,
        lambda t: F.struct(
            unescaped(F.regexp_replace(F.split(t, r"<\|text\|>")[0], r"^<\|turn\|>", "")).alias("role"),
            unescaped(F.split(t, r"<\|text\|>")[1]).alias("text"),
        ),
    )


def under_loss(formatted: Column, loss_spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    cut = lambda s: F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int"))
    return F.array_join(F.transform(loss_spans, lambda s: unescaped(cut(s))), "")


def as_chain(conversations: DataFrame) -> DataFrame:
    """Messages of conversations (conv_id, turn, role, text): each answers the one before.

    Turns go by number, missing numbers last, ties by role and text.
    """
    rank = Window.partitionBy("conv_id").orderBy(
        F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first()
    )
    numbered = conversations.select("conv_id", "turn", "role", "text").withColumn(
        "id", F.row_number().over(rank).cast("long")
    )
    return numbered.select(
        F.col("conv_id").alias("tree"),
        "id",
        F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"),
        F.lit(0.0).alias("score"),
        "role",
        "text",
    )
