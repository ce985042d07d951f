"""Chat formatting with DataFrame functions only: reply trees to root-to-leaf paths to marked-up conversations.

A turn is written as <|im_start|>role, a line feed, the text, <|im_end|> and a line feed. Inside texts every `<`, any
number of `!`, `|` gets one more `!`, so that no control string is left in them and reading takes one `!` away again.
Roles are written percent-encoded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from massspark.llm.common import written

START, END = "<|im_start|>", "<|im_end|>"
_ESCAPED, _UNESCAPED = "<(!*)\\|", "<!(!*)\\|"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "<!$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _UNESCAPED, "<$1|")


def paths(nodes: DataFrame, branches: int | None = None) -> DataFrame:
    """conv_id, leaf, place, node, rank, total: the nodes of the `branches` best root-to-leaf paths (None: all), root first.

    nodes: conv_id, node, parent (null: a root), score. Branches of a conversation are ranked by the sum of scores, then by
    leaf. A parent that isn't there makes its child a root; null scores count 0. Nodes must be unique in a conversation, and
    parents must not form rings (a ring or a leaf below one is an error).

    Self-joins find the ancestors 1, 2, 4, ... steps up with the scores below them, for as long as a node has one. Each leaf
    then climbs to its root, the longest steps first, which gives its total and depth before any path is listed. Only the
    chosen leaves' paths are filled in, every round at most doubling their nodes. A conversation of n turns takes about
    3 log n joins of n rows at most and, beyond those, no more rows than the chosen paths have.
    """
    kind = nodes.schema["conv_id"].dataType
    # joins and windows see null ids as one, and as another than an empty string
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("conv_id")
    known = written(nodes.select(key, "node", F.col("parent").alias("up"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")), "nodes")
    parents = known.select("conv_id", F.col("node").alias("up"))
    steps, most = [written(known.where("up is not null").join(parents, ["conv_id", "up"], "left_semi").select("conv_id", "node", "up", "score"), "steps")], known.count()
    while not steps[-1].isEmpty():
        if 1 << len(steps) > 2 * most + 2:
            raise ValueError("parents form a ring")
        further = steps[-1].select("conv_id", F.col("node").alias("up"), F.col("up").alias("next"), F.col("score").alias("more"))
        steps.append(written(steps[-1].join(further, ["conv_id", "up"]).select("conv_id", "node", F.col("next").alias("up"), (F.col("score") + F.col("more")).alias("score")), "steps"))
    steps.pop()
    leaves = known.select("conv_id", F.col("node").alias("leaf"), "node", F.lit(0.0).alias("total"), F.lit(0).cast("long").alias("place"))
    if steps:
        inner = steps[0].select("conv_id", F.col("up").alias("node")).distinct()
        leaves = leaves.join(inner, ["conv_id", "node"], "left_anti")
    for k, step in reversed(list(enumerate(steps))):
        climbed = leaves.join(step.withColumnRenamed("score", "more"), ["conv_id", "node"], "left")
        leaves = climbed.select(
            "conv_id",
            "leaf",
            F.coalesce("up", "node").alias("node"),
            (F.col("total") + F.coalesce("more", F.lit(0.0))).alias("total"),
            (F.col("place") + F.when(F.col("up").isNotNull(), 1 << k).otherwise(0)).alias("place"),
        )
    leaves = leaves.join(known.select("conv_id", "node", "score"), ["conv_id", "node"]).withColumn("total", F.col("total") + F.col("score"))
    leaves = leaves.withColumn("rank", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("total"), "leaf")))
    if branches is not None:
        leaves = leaves.where(F.col("rank") <= branches)
    found = written(leaves.select("conv_id", "leaf", F.col("leaf").alias("node"), "place", "rank", "total"), "leaves")
    for k, step in reversed(list(enumerate(steps))):
        more = found.join(step, ["conv_id", "node"]).select("conv_id", "leaf", F.col("up").alias("node"), (F.col("place") - (1 << k)).alias("place"), "rank", "total")
        found = written(found.unionByName(more), "paths")
    return found.select(F.when(F.col("conv_id") != "", F.expr("substring(conv_id, 2)")).cast(kind).alias("conv_id"), "leaf", "place", "node", "rank", "total")


def formatted(turns: DataFrame) -> DataFrame:
    """conv_id, formatted: one row per conversation of turns (conv_id, place, role, text), joined by place, role and text.

    Null texts and roles are empty; repeated rows are turns of their own; a null conv_id is a conversation.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    turn = F.concat(F.lit(START), F.url_encode(role), F.lit("\n"), escape(text), F.lit(END + "\n"))
    rows = turns.select("conv_id", F.struct("place", role.alias("role"), text.alias("text"), turn.alias("turn")).alias("t"))
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("t")), lambda t: t["turn"]), "").alias("formatted"))


def parsed(output: DataFrame) -> DataFrame:
    """conv_id, formatted, turns: an array of role, text, in order, read from the formatted strings."""
    pieces = F.filter(F.split("formatted", "<\\|im_start\\|>"), lambda p: p != "")

    def turn(piece):
        line = F.instr(piece, "\n")
        body = F.substring(piece, line + 1, F.length(piece) - line - F.lit(len(END) + 1))
        return F.struct(F.url_decode(F.substring(piece, F.lit(1), line - 1)).alias("role"), unescape(body).alias("text"))

    return output.select("conv_id", "formatted", F.transform(pieces, turn).alias("turns"))


def digests(read: DataFrame) -> DataFrame:
    """n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of each parsed conversation. Loss: assistant texts."""
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: t["text"]), "")
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def trees(conversations: DataFrame) -> DataFrame:
    """Rows by turn as a reply tree without branches: each turn answers the one before it (by turn, role, text)."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = conversations.select("conv_id", "turn", "role", "text").withColumn("node", F.row_number().over(order).cast("long"))
    return numbered.select("conv_id", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.length(F.coalesce("text", F.lit(""))).cast("double").alias("score"), "role", "text")


def format_best(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """conv_id, formatted: the `branches` best root-to-leaf paths of each tree, each as one conversation.

    nodes: conv_id, node, parent, score, role, text. With more than one branch, leaf tells the conversations apart.
    """
    chosen = paths(nodes, branches)
    text = nodes.select(F.col("conv_id").alias("c"), F.col("node").alias("n"), "role", "text")
    turns = chosen.join(text, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("node") == F.col("n"))).select(F.struct("conv_id", "leaf").alias("conv_id"), "place", "role", "text")
    return formatted(turns).select("conv_id.conv_id", "conv_id.leaf", "formatted")
