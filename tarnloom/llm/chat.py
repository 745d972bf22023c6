"""Chat formatting from reply trees, in DataFrame functions alone.

Messages point at the message they reply to. Pointer tables are self-joined until they reach the roots: after round k each
message knows the ancestor 2^k replies above it, its depth and the sum of scores on the way, so that a tree of depth d takes
log2(d) joins. The leaves of a tree are its branches; they are ranked by score, and the chosen ones are expanded to their
messages by the same tables, again in log2(d) joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import remove, staged

#: The template (fixed values): a turn is OPEN role ": " text CLOSE; nothing of it can occur in an escaped text.
OPEN, SEPARATOR, CLOSE = "### ", ": ", "</turn>\n"
#: Escapes in the order they are made; undone in the reverse order. Each stands for a string that the template uses.
ESCAPES = (("\\", "\\b"), ("### ", "\\h## "), ("</turn>", "\\s/turn>"))
ROLE_ESCAPES = (*ESCAPES, (": ", "\\c "))


def escape(text: Column, escapes: tuple = ESCAPES) -> Column:
    for a, b in escapes:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def unescape(text: Column, escapes: tuple = ESCAPES) -> Column:
    for a, b in reversed(escapes):
        text = F.replace(text, F.lit(b), F.lit(a))
    return text


def branches(messages: DataFrame, top: int | None = None) -> DataFrame:
    """(tree, branch, rank, depth, node): the messages on each chosen root-to-leaf path; depth counts from 0 at the root.

    messages: node (unique, not null), parent (null or unknown: a root), score (null: 0). branch is the path's leaf, tree its
    root. A tree's branches are ranked by the mean score on the path (equal ones by leaf); the first `top` are kept, or all.
    Messages on a cycle of replies have no root and are in no branch. Of a repeated node the row with the smallest parent
    (nulls first), then score, counts.
    """
    paths: list[str] = []
    nodes = messages.groupBy("node").agg(F.min(F.struct("parent", F.coalesce("score", F.lit(0.0)).cast("double").alias("score"))).alias("m"))
    nodes = staged(nodes.select("node", "m.parent", "m.score"), "messages", into=paths)
    known = nodes.select(F.col("node").alias("parent"), F.lit(True).alias("known"))
    # up: the ancestor so many replies above (null beyond the root); root: the last one seen; depth and total on the way
    base = nodes.join(known, "parent", "left").select("node", F.when(F.col("known"), F.col("parent")).alias("up"), "score")
    first = base.select("node", "up", F.coalesce("up", "node").alias("root"), F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("depth"), F.col("score").alias("total"))
    first = staged(first, "level", into=paths)
    done, active = first.filter(F.col("up").isNull()), first.filter(F.col("up").isNotNull())
    steps = []
    before = active.count()
    while before:  # only messages that have not reached their root are joined again
        steps.append(active.select("node", "up"))
        above = done.unionByName(active).select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("root").alias("root2"), F.col("depth").alias("depth2"), F.col("total").alias("total2"))
        joined = active.join(above, "up").select("node", F.col("up2").alias("up"), F.col("root2").alias("root"), (F.col("depth") + F.col("depth2")).alias("depth"), (F.col("total") + F.col("total2")).alias("total"))
        level = staged(joined, "level", into=paths)
        done, active = done.unionByName(level.filter(F.col("up").isNull())), level.filter(F.col("up").isNotNull())
        left = active.count()
        if left == before:  # only cycles are left: they never reach a root
            break
        before = left
    answered = base.filter(F.col("up").isNotNull()).select(F.col("up").alias("node")).distinct()
    leaves = done.join(answered, "node", "left_anti")
    mean = F.col("total") / (F.col("depth") + 1)
    ranked = leaves.select(F.col("root").alias("tree"), F.col("node").alias("branch"), F.row_number().over(Window.partitionBy("root").orderBy(mean.desc(), "node")).alias("rank"), "depth")
    if top is not None:
        ranked = ranked.filter(F.col("rank") <= top)
    path = ranked.select("tree", "branch", "rank", "depth", F.col("branch").alias("node"))
    # each table doubles the messages known of a path: from the largest step down to the parent
    for k, step in reversed(list(enumerate(steps))):
        more = path.join(step, "node").select("tree", "branch", "rank", (F.col("depth") - F.lit(1 << k)).alias("depth"), F.col("up").alias("node"))
        path = path.unionByName(more)
        if k % 2 == 0 and k:
            path = staged(path, "path")
    path = staged(path, "path")
    remove(messages.sparkSession, *paths)
    return path


def conversations(messages: DataFrame, top: int | None = 1, loss_role: str = "assistant") -> DataFrame:
    """(tree, branch, rank, n_turns, formatted, loss_spans): each chosen branch of messages as one conversation.

    messages: node, parent, score, role, text. Null roles and texts are empty. loss_spans lists the texts of loss_role:
    turn (from 0), start (code points from the start of formatted), offset (from the start of the turn) and length, of the
    escaped text. Of a repeated node the smallest row (by parent, score, role, text) counts, whole. See branches() for ties and
    cycles; an empty table gives an empty result.
    """
    empty = F.lit("")
    whole = F.struct("parent", F.coalesce("score", F.lit(0.0)).cast("double").alias("score"), F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    # one row a node, all of it from the same message; it is read once for the paths and once for the texts
    own = staged(messages.groupBy("node").agg(F.min(whole).alias("m")).select("node", "m.*"), "nodes")
    turns = branches(own, top).join(own.select("node", "role", "text"), "node")
    role, text = escape(F.col("role"), ROLE_ESCAPES), escape(F.col("text"))
    head = F.concat(F.lit(OPEN), role, F.lit(SEPARATOR))
    turns = turns.select("tree", "branch", "rank", "depth", F.concat(head, text, F.lit(CLOSE)).alias("block"), F.length(head).alias("offset"), F.length(text).alias("length"), (F.col("role") == loss_role).alias("loss"))
    before = Window.partitionBy("tree", "branch").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("start", F.coalesce(F.sum(F.length("block")).over(before), F.lit(0)).cast("long") + F.col("offset"))
    whole = turns.groupBy("tree", "branch", "rank").agg(F.array_sort(F.collect_list(F.struct("depth", "block", "start", "offset", "length", "loss"))).alias("t"))
    names = ("start", "offset", "length")
    numbered = F.transform("t", lambda x, i: F.struct(i.alias("turn"), *[x[n].alias(n) for n in (*names, "loss")]))
    spans = F.transform(F.filter(numbered, lambda s: s["loss"]), lambda s: F.struct(*[s[n].alias(n) for n in ("turn", *names)]))
    formatted = F.concat_ws("", F.transform("t", lambda x: x["block"]))
    return whole.select("tree", "branch", "rank", F.size("t").cast("long").alias("n_turns"), formatted.alias("formatted"), spans.alias("loss_spans"))


def parsed(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text), unescaped."""
    parts = F.split(formatted, CLOSE, -1)
    blocks = F.slice(parts, 1, F.size(parts) - 1)
    body = lambda b: F.substr(b, F.lit(len(OPEN) + 1))
    role = lambda b: F.substring_index(body(b), SEPARATOR, 1)
    return F.transform(blocks, lambda b: F.struct(unescape(role(b), ROLE_ESCAPES).alias("role"), unescape(F.substr(body(b), F.length(role(b)) + len(SEPARATOR) + 1)).alias("text")))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    blocks = F.split(formatted, CLOSE, -1)
    return F.concat_ws("", F.transform(spans, lambda s: unescape(F.substr(F.get(blocks, s["turn"]), s["offset"] + 1, s["length"]))))


def as_replies(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Conversations given as rows by turn, as messages: each turn replies to the one before it; node is (conversation, place).

    Turns stand in the order of turn (nulls first), equal ones by role and text. Repeated rows are turns of their own; rows
    without a conversation id are one conversation.
    """
    order = Window.partitionBy(conv_id).orderBy(F.col(turn), F.col("role"), F.col("text"))
    at = F.row_number().over(order).cast("long")
    # the place is fixed-width so that node sorts as (conversation, place)
    rows = rows.select(F.col(conv_id).alias("conv"), at.alias("place"), "role", "text")
    node = lambda place: F.struct(F.col("conv"), place.alias("place"))
    return rows.select(node(F.col("place")).alias("node"), F.when(F.col("place") > 1, node(F.col("place") - 1)).alias("parent"), F.lit(1.0).alias("score"), "role", "text")
