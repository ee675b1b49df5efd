"""Chat formatting of reply trees, with DataFrame functions only.

Root-to-leaf paths come from iterative self-joins: round k joins the table of 2^k-th ancestors with itself, so that a
chain of n replies takes about log2(n) rounds, and each leaf then gathers its ancestors by those tables. Branches are
ranked by their summed score, and each chosen path becomes one conversation. Every round is a written table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

START, END = "<|im_start|>", "<|im_end|>"
STRETCH = 10_000


def escape(text: Column) -> Column:
    """No control string is left: `&` is written `&amp;`, and `<|` is written `&lt;|`."""
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("&nl;"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("&nl;"), F.lit("\n")))


def reply_paths(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """nodes(tree, node, parent) -> (tree, leaf, node, up): every node of each root-to-leaf path, up being the number
    of steps from the leaf. A parent that is missing from its tree counts as none; replies in or behind a cycle have
    no root and give no path; (tree, node) must be unique."""
    known = nodes.select("tree", F.col("node").alias("parent"))
    step = nodes.where("parent is not null and parent <> node").select("tree", "node", "parent").join(known, ["tree", "parent"], "left_semi")
    jump = scratch.table(step.select("tree", "node", F.col("parent").alias("up_node")), "jump0")
    jumps, most = [jump], nodes.groupBy("tree").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    while 2 ** len(jumps) <= most:
        far = jump.select("tree", F.col("node").alias("up_node"), F.col("up_node").alias("far"))
        jump = scratch.table(jump.join(far, ["tree", "up_node"]).select("tree", "node", F.col("far").alias("up_node")), f"jump{len(jumps)}")
        if not jump.limit(1).count():
            break
        jumps.append(jump)
    if 2 ** len(jumps) > most and most:  # who still has an ancestor this far up stands in or behind a cycle
        far = jumps[-1].select("tree", F.col("node").alias("up_node"), F.col("up_node").alias("far"))
        endless = jumps[-1].join(far, ["tree", "up_node"]).select("tree", F.col("node").alias("leaf"))
    leaves = nodes.select("tree", "node").join(jumps[0].select("tree", F.col("up_node").alias("node")), ["tree", "node"], "left_anti")
    paths = leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up"))
    for k in range(len(jumps) - 1, -1, -1):
        above = paths.join(jumps[k], ["tree", "node"]).select("tree", "leaf", F.col("up_node").alias("node"), (F.col("up") + 2**k).alias("up"))
        paths = scratch.table(paths.unionByName(above), f"paths{k}")
    return paths.join(endless, ["tree", "leaf"], "left_anti") if 2 ** len(jumps) > most and most else paths


def before_in_path(turns: DataFrame, value: str, name: str) -> DataFrame:
    """Adds name: the sum of value over the turns of the same path that stand before. A path is summed in stretches of
    STRETCH turns, so that a long one is not one task's window."""
    keys = ["tree", "leaf", "stretch"]
    rows = turns.withColumn("stretch", F.floor(F.col("up") / STRETCH))
    own = Window.partitionBy(*keys).orderBy(F.desc("up")).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*keys).agg(F.sum(value).alias("all"))
    ahead = Window.partitionBy("tree", "leaf").orderBy(F.desc("stretch")).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, F.coalesce(F.sum("all").over(ahead), F.lit(0)).alias("ahead"))  # a row a stretch
    summed = rows.withColumn("own", F.coalesce(F.sum(value).over(own), F.lit(0))).join(sums, keys)
    return summed.withColumn(name, F.col("own") + F.col("ahead")).drop("stretch", "own", "ahead")


def format_trees(messages: DataFrame, scratch: Scratch, branches: int | None = None) -> DataFrame:
    """messages(tree, node, parent, role, text, score) -> one row for each chosen path: tree, leaf, branch (rank by
    summed score, then length, then leaf; 1 is best), score, formatted, and loss_mask array<struct<start, chars>> in
    code points (from 0) over formatted, which covers the assistant's texts. branches: how many paths of each tree
    are formatted, all if None. Null roles and texts count as empty, null scores as 0."""
    paths = reply_paths(messages.select("tree", "node", "parent"), scratch)
    said = messages.select("tree", "node", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    scores = paths.join(said.select("tree", "node", "score"), ["tree", "node"]).groupBy("tree", "leaf").agg(F.sum("score").alias("score"), F.count("*").alias("n"))
    order = Window.partitionBy("tree").orderBy(F.desc("score"), F.desc("n"), "leaf")
    ranked = scores.withColumn("branch", F.row_number().over(order))  # a slim row a path
    if branches is not None:
        ranked = ranked.where(F.col("branch") <= branches)
    ranked = scratch.table(ranked.select("tree", "leaf", "branch", "score"), "ranked")
    turns = paths.join(ranked.select("tree", "leaf"), ["tree", "leaf"], "left_semi").join(said.drop("score"), ["tree", "node"])
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    body = escape(F.col("text"))
    placed = turns.withColumns({"head": head, "body": body}).withColumn("chars", (F.length("head") + F.length("body") + F.lit(len(END) + 1)).cast("long"))
    placed = before_in_path(placed, "chars", "at").withColumn("at", F.col("at") + F.length("head"))
    piece = F.struct(
        (-F.col("up")).alias("order"), F.concat("head", "body", F.lit(END + "\n")).alias("piece"),
        (F.col("role") == "assistant").alias("learn"), F.col("at").alias("start"), F.length("body").cast("long").alias("chars"),
    )
    grouped = placed.groupBy("tree", "leaf").agg(F.sort_array(F.collect_list(piece)).alias("pieces"))
    return grouped.join(ranked, ["tree", "leaf"]).select(
        "tree", "leaf", "branch", "score", F.array_join(F.transform("pieces", lambda p: p.piece), "").alias("formatted"),
        F.transform(F.filter("pieces", lambda p: p.learn), lambda p: F.struct(p.start.alias("start"), p.chars.alias("chars"))).alias("loss_mask"),
    )


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation."""
    parts = F.split(formatted, r"<\|im_start\|>", -1)
    pieces = F.slice(parts, F.lit(2), F.size(parts) - 1)

    def turn(p: Column) -> Column:
        role = F.substring_index(p, "\n", 1)
        skip = F.length(role) + 1
        return F.struct(unescape_role(role).alias("role"), unescape(F.substr(p, skip + 1, F.length(p) - skip - F.lit(len(END) + 1))).alias("text"))

    return F.transform(pieces, turn)


def under_mask(formatted: Column, mask: Column) -> Column:
    """The unescaped text that a loss mask covers."""
    return F.array_join(F.transform(mask, lambda m: unescape(F.substr(formatted, m.start.cast("int") + 1, m.chars.cast("int")))), "")


def numbered_turns(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Adds node: the turn's number in its tree, from 1, by turn, role, text. Rows are dealt by ranges of that order and
    written, each range numbers its part of a tree, and what stands in earlier ranges is added: no tree is one task's
    window, however many rows it has."""
    order = ["tree", "turn", "role", "text"]
    dealt = scratch.table(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "dealt")
    sizes = dealt.groupBy("tree", "part").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("tree", "part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))  # a row a range
    own = F.row_number().over(Window.partitionBy("tree", "part").orderBy("turn", "role", "text"))
    return dealt.withColumn("own", own).join(sizes, ["tree", "part"]).withColumn("node", (F.col("own") + F.col("ahead")).cast("long")).drop("part", "own", "ahead")


def format_conversations(conversations: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) -> conv_id, formatted, loss_mask: each conversation is a chain of
    replies by turn (ties by role, then text; null turns first) and so has one path. Rows with a null conv_id are one
    conversation; repeated rows are repeated turns; long texts are kept whole; an empty table gives no row; other columns
    are ignored. Only the text of a conversation, which is one row, meets in one task."""
    tree = F.when(F.col("conv_id").isNull(), "-").otherwise(F.concat(F.lit("="), F.col("conv_id").cast("string")))
    scratch = Scratch(conversations.sparkSession, "chat")
    rows = numbered_turns(conversations.select(tree.alias("tree"), "turn", "role", "text"), scratch)
    messages = scratch.table(rows.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score")), "messages")
    scratch.drop("dealt")
    out = format_trees(messages, scratch)
    return out.select(F.when(F.col("tree") != "-", F.substring("tree", 2, 30).cast("long")).alias("conv_id"), "formatted", "loss_mask")


def digest(formatted: DataFrame) -> DataFrame:
    """Digests of what is read back from formatted(conv_id, formatted, loss_mask)."""
    turns = formatted.withColumn("turns", read_back(F.col("formatted"))).withColumn("learned", under_mask(F.col("formatted"), F.col("loss_mask")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return turns.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
