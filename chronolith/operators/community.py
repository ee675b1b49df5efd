"""Community detection by capped synchronous label propagation, and bounded community summaries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolith.functions import plugins

from .order import numbered, saved

ROUNDS, MEMBERS = 50, 200


def adjacency(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst, weight) from both ends of edges(src, dst), and singletons with null dst."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    counted = both.groupBy("src", "dst").agg(F.count("*").alias("weight"))
    alone = nodes.select(F.col("node").alias("src")).join(counted.select("src"), "src", "left_anti")
    return counted.unionByName(alone.select("src", F.lit(None).cast(counted.schema["dst"].dataType).alias("dst"), F.lit(0).cast("long").alias("weight")))


def label_propagation(adjacent: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(node, label): labels start as the nodes' ordinals; in each round every node takes the label with the largest
    (weight sum, label) among its neighbours if that sum is above 1, else the larger of it and its own; isolated nodes
    keep theirs. Ends when nothing changes or after `rounds`, as a synchronous update may swing for ever.

    Each round is one aggregation by (node, label); checkpoints cut the lineage every few rounds, and the change test
    is part of the checkpointed round."""
    nodes = adjacent.select(F.col("src").alias("node")).distinct()
    ids = saved(numbered(nodes, "node").withColumnRenamed("number", "label"))
    weights = saved(adjacent.where("dst is not null").select(F.col("src").alias("node"), F.col("dst").alias("other"), "weight"))
    labels = ids
    for _ in range(rounds):
        near = weights.join(labels.select(F.col("node").alias("other"), "label"), "other").groupBy("node", "label").agg(F.sum("weight").alias("rank"))
        best = near.groupBy("node").agg(F.max(F.struct("rank", "label")).alias("best"))
        pick = F.when(F.col("best").isNull(), F.col("label")).when(F.col("best.rank") > 1, F.col("best.label")).otherwise(F.greatest("best.label", "label"))
        new = saved(labels.join(best, "node", "left").select("node", pick.alias("label"), (pick != F.col("label")).alias("moved")))
        moved = new.where("moved").limit(1).count()
        labels = new.select("node", "label")
        if not moved:
            break
    return labels


def propagate_active(adjacent: DataFrame, rounds: int = ROUNDS, start: DataFrame | None = None) -> DataFrame:
    """The same labels as `label_propagation`, round by round, from sums that are kept: a node that moves takes its weight
    from its neighbours' sums for its old label and adds it to those for its new one, and only these neighbours, and nodes
    that moved themselves, choose again. What a round shuffles is what moved, not the graph. `start(node, label)` are labels
    to begin with, as those of the last run where edges were added; nodes that it lacks get numbers above all its labels."""
    nodes = adjacent.select(F.col("src").alias("node")).distinct()
    if start is None:
        labels = saved(numbered(nodes, "node").withColumnRenamed("number", "label"))
    else:
        above = (start.agg(F.max("label")).first()[0] if start.limit(1).count() else -1) + 1
        fresh = numbered(nodes.join(start.select("node"), "node", "left_anti"), "node").select("node", (F.col("number") + above).alias("label"))
        labels = saved(nodes.join(start.select("node", "label"), "node").unionByName(fresh))
    weights = saved(adjacent.where("dst is not null").select(F.col("src").alias("node"), F.col("dst").alias("other"), "weight"))
    sums = saved(weights.join(labels.select(F.col("node").alias("other"), "label"), "other").groupBy("node", "label").agg(F.sum("weight").alias("rank")))
    touched, corrections = None, None
    for n in range(rounds):
        if n % 8 == 7:
            corrections = saved(corrections.groupBy("node", "label").agg(F.sum("rank").alias("rank")))
        known = sums if corrections is None else sums.unionByName(corrections)
        if touched is not None:
            known = known.join(touched, "node", "left_semi")
        near = known.groupBy("node", "label").agg(F.sum("rank").alias("rank")).where("rank > 0")
        best = near.groupBy("node").agg(F.max(F.struct("rank", "label")).alias("best"))
        asked = labels if touched is None else labels.join(touched, "node", "left_semi")
        pick = F.when(F.col("best").isNull(), F.col("label")).when(F.col("best.rank") > 1, F.col("best.label")).otherwise(F.greatest("best.label", "label"))
        moved = saved(asked.join(best, "node", "left").select("node", F.col("label").alias("old"), pick.alias("new")).where("new <> old"))
        if not moved.limit(1).count():
            break
        labels = saved(labels.join(moved.select("node", "new"), "node", "left").select("node", F.coalesce("new", "label").alias("label")))
        told = weights.join(moved.withColumnRenamed("node", "other"), "other").select("node", F.inline(F.array(F.struct(F.col("old").alias("label"), (-F.col("weight")).alias("rank")), F.struct(F.col("new").alias("label"), F.col("weight").alias("rank")))))
        told = saved(told.groupBy("node", "label").agg(F.sum("rank").alias("rank")))
        corrections = told if corrections is None else corrections.unionByName(told)
        touched = saved(told.select("node").unionByName(moved.select("node")).distinct())
    return labels


def sample_members(members: DataFrame, cap: int = MEMBERS) -> DataFrame:
    """At most `cap` members(community, node) of each community, by a seeded hash: a sampling operator."""
    w = Window.partitionBy("community").orderBy(F.xxhash64(F.col("node"), F.lit(42)), "node")
    return members.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= cap).drop("rn")


def summaries(members: DataFrame, cap: int = MEMBERS) -> DataFrame:
    """members(community, node, summary) -> (community, members, name, summary): the coarse summary joins the first
    five members' summaries, and the name is its first 60 code points."""
    size = members.groupBy("community").agg(F.count("*").alias("members"))
    some = sample_members(members, cap).withColumn("rn", F.row_number().over(Window.partitionBy("community").orderBy("node"))).where("rn <= 5")
    text = some.groupBy("community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "summary"))), lambda s: s.summary), "; ").alias("summary"))
    return size.join(text, "community").select("community", "members", F.substring("summary", 1, 60).alias("name"), "summary")


def tree_reduce(members: DataFrame, limit: int = 400, combiner: Callable[[Column, Column], Column] = plugins.combine) -> DataFrame:
    """members(community, ord, summary) -> (community, summary): summaries of the first half are combined with those of the
    second, an odd last one is kept for the next level, until one is left, which is cut at a sentence within `limit`.
    Bounded by the sample that comes before (at most MEMBERS of a community)."""
    ordered = members.groupBy("community").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "summary"))), lambda s: s.summary).alias("level"))
    for _ in range(MEMBERS.bit_length()):
        half = F.floor(F.size("level") / 2).cast("int")
        pairs = F.zip_with(F.slice("level", F.lit(1), half), F.slice("level", half + 1, half), lambda a, b: combiner(a, b))
        rest = F.slice("level", half * 2 + 1, F.size("level") - half * 2)
        ordered = ordered.withColumn("level", F.when(F.size("level") > 1, F.concat(pairs, rest)).otherwise(F.col("level")))
    return ordered.select("community", plugins.combine(F.element_at("level", 1), F.lit(None).cast("string"), limit).alias("summary"))
