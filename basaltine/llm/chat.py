"""Chat formatting over reply trees (native).

Messages name their parents. Pointer doubling, a self-join a round, takes every message to its root and adds up the
scores on the way; the leaves of a conversation are ranked by their paths' scores, and the chosen paths are spelled out
by the same jump tables, from the longest jump to the shortest. Depth costs a logarithm of rounds, not a round a turn,
and only chosen paths meet their texts: the jump tables hold ids and numbers alone.

Where all texts are chosen anyway, as in conversations without branches, texts and paths are shuffled once, together
and by conversation, and meet in sorted windows of that one exchange; a conversation is one row in the end.

A turn is written as ``### role: text</turn>`` and a line end. Inside texts and roles a backslash is doubled and every
``###`` and ``</turn>`` is broken up by one, so that the marks never come from a text; dropping one backslash before
any character restores it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basaltine.llm.scratch import saved
from basaltine.llm.words import whole

HEAD, MIDDLE, END = "### ", ": ", "</turn>\n"
#: Rounds of doubling; deeper trees than two to this number of messages do not exist, cycles do.
ROUNDS = 48


def escaped(text: Column) -> Column:
    """``text`` without any control string."""
    t = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    t = F.regexp_replace(t, "#(?=##)", r"#\\")
    return F.replace(t, F.lit("</turn>"), F.lit("<\\/turn>"))


def unescaped(text: Column) -> Column:
    """The text that ``escaped`` was given."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _on(a: DataFrame, b: DataFrame, **keys: str) -> Column:
    """Equal in conversation (null is a conversation too) and in the named columns."""
    cond = a["conv"].eqNullSafe(b["b_conv"])
    for mine, theirs in keys.items():
        cond = cond & (a[mine] == b[theirs])
    return cond


def chosen_paths(nodes: DataFrame, best: int = 1) -> DataFrame:
    """nodes (conv, node, parent, score) to (conv, leaf, place, node, distance) of each conversation's best paths.

    Paths rank by the sum of their scores (null: 0), then by depth, then by the smaller leaf. ``place`` is the rank
    from 1, ``distance`` that to the leaf. A parent that is not there makes its child a root. Nodes are unique in a
    conversation. A cycle of parents raises ValueError.
    """
    known = nodes.select(F.col("conv").alias("b_conv"), F.col("node").alias("b_node"))
    jump = saved(
        nodes.join(known, _on(nodes, known, parent="b_node"), "left").select(
            "conv", "node", F.col("b_node").alias("up"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("total"), F.lit(1).cast("long").alias("depth")
        )
    )
    # messages still on their way up, and those that have reached their root; only the former go on
    jumps, arrived = [], jump.where("up is null")
    jump = jump.where("up is not null")
    while not jump.isEmpty():
        if len(jumps) == ROUNDS:
            raise ValueError("the parents of some messages form a cycle")
        jumps.append(jump)
        above = jump.unionByName(arrived)
        above = above.select(F.col("conv").alias("b_conv"), F.col("node").alias("b_node"), F.col("up").alias("b_up"), F.col("total").alias("b_total"), F.col("depth").alias("b_depth"))
        further = saved(
            jump.join(above, _on(jump, above, up="b_node")).select(
                "conv", "node", F.col("b_up").alias("up"), (F.col("total") + F.col("b_total")).alias("total"), (F.col("depth") + F.col("b_depth")).alias("depth")
            )
        )
        arrived = arrived.unionByName(further.where("up is null"))
        jump = further.where("up is not null")
    parents = nodes.where("parent is not null").select(F.col("conv").alias("b_conv"), F.col("parent").alias("b_node")).distinct()
    leaves = arrived.join(parents, _on(arrived, parents, node="b_node"), "left_anti")
    rank = F.struct((-F.col("total")).alias("t"), (-F.col("depth")).alias("d"), F.col("node").alias("leaf"))
    if best == 1:
        top = leaves.groupBy("conv").agg(F.min(rank).alias("r")).select("conv", F.col("r.leaf").alias("leaf"), F.lit(1).alias("place"))
    else:
        order = Window.partitionBy("conv").orderBy(rank)
        top = leaves.select("conv", F.col("node").alias("leaf"), F.row_number().over(order).alias("place")).where(F.col("place") <= best)
    paths = top.select("conv", "leaf", "place", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("distance"))
    for k in reversed(range(len(jumps))):
        paths = saved(paths)
        up = jumps[k].select(F.col("conv").alias("b_conv"), F.col("node").alias("b_node"), F.col("up").alias("b_up"))
        further = paths.join(up, _on(paths, up, node="b_node")).select("conv", "leaf", "place", F.col("b_up").alias("node"), (F.col("distance") + (1 << k)).alias("distance"))
        paths = paths.unionAll(further)
    return paths


def format_trees(messages: DataFrame, best: int = 1, learn: str = "assistant") -> DataFrame:
    """messages (conv, node, parent, role, text, score) to one row per chosen path.

    Returns conv, leaf, place, n_turns, formatted, loss_spans: places in code points (start, end) of what a model is
    to learn, the escaped texts of the role ``learn``. Null texts and roles are empty. Other columns are not read.
    """
    paths = chosen_paths(messages.select("conv", "node", "parent", "score"), best)
    texts = messages.select(F.col("conv").alias("b_conv"), F.col("node").alias("b_node"), whole("role").alias("role"), whole("text").alias("text"))
    return _formatted(paths.join(texts, _on(paths, texts, node="b_node")), learn)


def _formatted(turns: DataFrame, learn: str) -> DataFrame:
    """Turns (conv, leaf, place, distance, role, text), none null, to a row per path."""
    head = F.concat(F.lit(HEAD), F.replace(escaped(F.col("role")), F.lit(":"), F.lit("\\:")), F.lit(MIDDLE))
    turns = turns.select("conv", "leaf", "place", "distance", (F.col("role") == learn).alias("learn"), head.alias("head"), escaped(F.col("text")).alias("body"))
    size = F.length("head") + F.length("body") + len(END)
    before = Window.partitionBy("conv", "leaf").orderBy(F.desc("distance")).rowsBetween(Window.unboundedPreceding, -1)
    placed = turns.withColumn("start", (F.coalesce(F.sum(size).over(before), F.lit(0)) + F.length("head")).cast("long"))
    turn = F.struct((-F.col("distance")).alias("at"), F.concat("head", "body", F.lit(END)).alias("written"), "start", (F.col("start") + F.length("body")).alias("end"), "learn")
    grouped = placed.groupBy("conv", "leaf").agg(F.first("place").alias("place"), F.sort_array(F.collect_list(turn)).alias("turns"))
    return grouped.select(
        "conv",
        "leaf",
        "place",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: t["written"]), "").alias("formatted"),
        F.transform(F.filter("turns", lambda t: t["learn"]), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"))).alias("loss_spans"),
    )


def format_conversations(conversations: DataFrame, learn: str = "assistant") -> DataFrame:
    """Rows (conv_id, turn, role, text) without branches, each turn the answer to the one before: as ``format_trees``.

    Rows of a conversation go by turn, nulls first; rows with one turn by role and text; a null conv_id is a
    conversation, null roles and texts are empty. An empty table gives no rows; other columns are not read.
    """
    # the tree needs only how many rows a conversation has
    counts = conversations.groupBy(F.col("conv_id").alias("conv")).agg(F.count("*").alias("n"))
    nodes = counts.select("conv", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("node"))
    nodes = nodes.select("conv", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.lit(0.0).alias("score"))
    paths = chosen_paths(nodes).select("conv", "node", "leaf", "place", "distance")
    texts = conversations.select(F.col("conv_id").alias("conv"), "turn", "role", "text", F.lit(True).alias("said"))
    both = texts.unionByName(paths.withColumn("said", F.lit(False)), allowMissingColumns=True)
    # all windows are by conversation first, so one exchange serves them
    order = Window.partitionBy("conv").orderBy(F.desc("said"), "turn", "role", "text")
    both = both.withColumn("node", F.when(F.col("said"), F.row_number().over(order).cast("long")).otherwise(F.col("node")))
    meet = Window.partitionBy("conv", "node").orderBy("said").rowsBetween(-1, -1)
    path = F.first(F.struct("leaf", "place", "distance")).over(meet)
    met = both.select("conv", "said", whole("role").alias("role"), whole("text").alias("text"), path.alias("path")).where("said")
    return _formatted(met.select("conv", "path.*", "role", "text"), learn)


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>>: the turns that a formatted conversation holds."""
    parts = F.filter(F.split(formatted, END), lambda p: p != "")
    shape = r"(?s)^### ((?:[^\\:]|\\.)*+): (.*)$"
    return F.transform(
        parts, lambda p: F.struct(unescaped(F.regexp_extract(p, shape, 1)).alias("role"), unescaped(F.regexp_extract(p, shape, 2)).alias("text"))
    )


def loss_text(formatted: Column, spans: Column) -> Column:
    """The unescaped text under the loss mask."""
    under = F.transform(spans, lambda s: unescaped(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return F.array_join(under, "")
