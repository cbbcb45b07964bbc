"""Chat formatting of reply trees, in DataFrame functions only.

Messages (tree, node, parent, role, text, score) form trees.  Self-joins that double their
reach find each message's root, depth and the sum of scores from the root: a chain of n
messages takes log2(n) joins.  Messages without replies are leaves; each tree's branches are
ranked by their mean score; the chosen leaves' paths are unrolled by the same doubled links;
and each path is formatted as one conversation.

The template writes ``<|im_start|>role`` + newline + text + ``<|im_end|>`` + newline for each turn.
In texts, ``<`` followed by any number of backslashes and ``|`` gets one more backslash, so that no
control string is left, and reading takes it off again; in roles ``%``, newlines and ``<`` are
written as ``%25``, ``%0A``, ``%3C``.  ``loss_spans`` are the character ranges of the assistant's texts.

Defined results: null texts and roles are empty; a message whose parent is null or does not
exist is a root; of rows of one (tree, node) the least by (parent, role, text, score) is taken; ties of
score go to the smaller leaf; messages without a tree id belong to no conversation; a cycle has no root and gives no path; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Stored, scratch

START, END = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")), F.lit("<"), F.lit("%3C"))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%3C"), F.lit("<")), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def chains(turns: DataFrame) -> DataFrame:
    """Messages of linear conversations (conv_id, turn, role, text): each answers the one before,
    in the order of (turn, role, text)."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = turns.select("conv_id", "role", "text", F.row_number().over(order).cast("long").alias("node"))
    parent = F.when(F.col("node") > 1, F.col("node") - 1)
    return rows.select(F.col("conv_id").alias("tree"), "node", parent.alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def once(messages: DataFrame) -> DataFrame:
    """The least row of each (tree, node), the same wherever it is asked for."""
    least = F.min(F.struct("parent", "role", "text", "score")).alias("m")
    return messages.groupBy("tree", "node").agg(least).select("tree", "node", "m.parent", "m.role", "m.text", "m.score")


def paths(messages: DataFrame, best: int = 1) -> DataFrame:
    """(tree, leaf, node, depth) of the messages on the ``best`` highest branches of each tree;
    ``messages`` has a row a (tree, node), as ``once`` gives."""
    with scratch():
        return _paths(messages, best).keep().df


def _paths(messages: DataFrame, best: int) -> Stored:
    links = messages.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    known = links.select("tree", F.col("node").alias("parent"), F.lit(True).alias("known"))
    links = links.join(known, ["tree", "parent"], "left")
    links = Stored(links.select("tree", "node", F.when(F.col("known"), F.col("parent")).alias("up"), F.col("score").alias("sum"), F.lit(1).alias("steps")), "links").df
    most = links.count()
    rooted = links.filter("up IS NULL")  # messages that have met their root, with the sum of scores and the number from it
    jumps = [links.filter("up IS NOT NULL")]  # jumps[i]: of the others, the message 2^i above
    while jumps[-1].limit(1).count():
        now = jumps[-1]
        above = now.unionByName(rooted).select("tree", F.col("node").alias("up"), F.col("up").alias("further"), F.col("sum").alias("sum2"), F.col("steps").alias("steps2"))
        joined = now.join(above, ["tree", "up"])
        joined = joined.select("tree", "node", F.col("further").alias("up"), (F.col("sum") + F.col("sum2")).alias("sum"), (F.col("steps") + F.col("steps2")).alias("steps"))
        joined = Stored(joined, "jumps").df
        rooted = rooted.unionByName(joined.filter("up IS NULL"))
        jumps.append(joined.filter("up IS NOT NULL"))
        if 1 << (len(jumps) - 1) > most:
            break  # longer than all messages together: what is left are cycles
    replied = jumps[0].select("tree", F.col("up").alias("node")).distinct()
    leaves = rooted.select("tree", "node", "sum", "steps").join(replied, ["tree", "node"], "left_anti")
    branch = F.struct((-F.col("sum") / F.col("steps")).alias("s"), "node", "steps")
    if best == 1:
        chosen = leaves.groupBy("tree").agg(F.min(branch).alias("b")).select("tree", "b.node", "b.steps")
    else:
        # Spark limits each group to ``best`` rows a task before the shuffle: a tree's leaves never meet in one task.
        rank = F.row_number().over(Window.partitionBy("tree").orderBy((F.col("sum") / F.col("steps")).desc(), "node"))
        chosen = leaves.withColumn("r", rank).filter(F.col("r") <= best).select("tree", "node", "steps")
    out = Stored(chosen.select("tree", F.col("node").alias("leaf"), "node", F.col("steps").alias("depth")), "paths")
    for i, jump in enumerate(jumps[:-1]):
        up = jump.select("tree", "node", "up")
        further = out.df.join(up, ["tree", "node"]).select("tree", "leaf", F.col("up").alias("node"), (F.col("depth") - (1 << i)).alias("depth"))
        out = Stored(out.df.unionByName(further), "paths")
    return out


def format_paths(messages: DataFrame, chosen: DataFrame) -> DataFrame:
    """(tree, leaf, formatted, loss_spans): a conversation for each path; ``messages`` has a row a
    (tree, node).  A turn's start is a running sum of its path's lengths."""
    rows = chosen.join(messages.select("tree", "node", "role", "text"), ["tree", "node"])
    role, text = F.coalesce("role", F.lit("")), escape(F.coalesce("text", F.lit("")))
    head = F.concat(F.lit(START), escape_role(role), F.lit("\n"))
    rows = rows.select("tree", "leaf", "depth", (role == "assistant").alias("loss"), head.alias("head"), text.alias("body"))
    size = (F.length("head") + F.length("body") + F.lit(len(END))).cast("long")
    path = Window.partitionBy("tree", "leaf").orderBy("depth")
    start = F.sum(size).over(path.rowsBetween(Window.unboundedPreceding, 0)) - F.length("body") - F.lit(len(END))
    rows = rows.withColumn("start", start)
    span = F.when(F.col("loss"), F.struct(F.col("start"), (F.col("start") + F.length("body")).alias("stop")))
    turns = F.sort_array(F.collect_list(F.struct("depth", F.concat("head", "body", F.lit(END)).alias("turn"))))
    out = rows.groupBy("tree", "leaf").agg(turns.alias("turns"), F.sort_array(F.collect_list(span)).alias("loss_spans"))
    return out.select("tree", "leaf", F.array_join(F.transform("turns", lambda t: t.turn), "").alias("formatted"), "loss_spans")


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    parts = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda x: x != "")
    body = lambda x: F.substring(x, F.instr(x, "\n") + 1, F.length(x))
    return F.transform(
        parts, lambda x: F.struct(unescape_role(F.substring_index(x, "\n", 1)).alias("role"), unescape(F.substring(body(x), F.lit(1), F.length(body(x)) - len(END))).alias("text"))
    )


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s.start.cast("int") + 1, (s.stop - s.start).cast("int")))), "")


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans) of linear conversations."""
    messages = chains(turns)
    return format_paths(messages, paths(messages)).select(F.col("tree").alias("conv_id"), "formatted", "loss_spans")
