"""Entity resolution: candidates by blocking keys, merge groups by connected components, repointing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolith.functions import plugins
from chronolith.functions import text as T

from .order import saved

#: Characters that generic words may add, merges in one run.
LENGTH_DIFFERENCE, MAX_MERGES = 12, 40


def same_key(entities: DataFrame) -> DataFrame:
    """entities(uuid, name, summary) -> (canonical, duplicate): equal normalised names within a group; canonical is
    the one with the longest summary, then the smallest uuid. One aggregation and a join back, no pairs."""
    keyed = entities.withColumn("key", T.entity_key(F.col("name"))).where("key <> ''")
    best = keyed.groupBy("key").agg(F.min(F.struct(-F.length(F.coalesce("summary", F.lit(""))), "uuid")).alias("best"), F.count("*").alias("n")).where("n > 1")
    return keyed.join(best, "key").where(F.col("best.uuid") != F.col("uuid")).select(F.col("best.uuid").alias("canonical"), F.col("uuid").alias("duplicate"))


def generic_names(entities: DataFrame) -> DataFrame:
    """(shorter, longer) of names where the longer one adds generic words only.

    A longer name starts or ends with the shorter and has at most LENGTH_DIFFERENCE characters more: each name explodes
    into its prefixes and suffixes shorter by so many, which meet the names by equality, and the rule verifies."""
    names = entities.select(F.lower("name").alias("low"), "name").groupBy("low").agg(F.min("name").alias("name"))
    # lower case can be longer than the name
    most = F.least(F.length("low") - 1, LENGTH_DIFFERENCE + F.greatest(F.length("low") - F.length("name"), F.lit(0)))
    cuts = names.where(F.length("low") > 1).select("low", "name", F.explode(F.sequence(F.lit(1), most)).alias("cut"))
    ends = F.array(F.substr("low", F.lit(1), F.length("low") - F.col("cut")), F.substr("low", F.col("cut") + 1))
    rows = cuts.select(F.col("name").alias("longer"), F.explode(F.array_distinct(ends)).alias("form"))
    pairs = rows.join(names.select(F.col("low").alias("form"), F.col("name").alias("shorter")), "form")
    near = F.length("longer") - F.length("shorter") <= LENGTH_DIFFERENCE
    return pairs.where(near & T.generic_remainder(F.col("shorter"), F.col("longer"))).select("shorter", "longer").distinct()


def candidates(entities: DataFrame, same: Callable[[Column, Column], Column] = plugins.same_entity) -> DataFrame:
    """entities(uuid, name, summary) -> pairs (canonical, duplicate) of both tiers: equal keys, and names that add generic
    words, which the judge `same` confirms. Entities of one name in any case stand for each other in the second tier, so
    each name brings one pair."""
    keyed = same_key(entities)
    one = entities.groupBy(F.lower("name").alias("low")).agg(F.min("uuid").alias("uuid"))
    again = entities.select(F.lower("name").alias("low"), "uuid").join(one.withColumnRenamed("uuid", "canonical"), "low").where("uuid <> canonical")
    near = generic_names(entities).where(same(F.col("shorter"), F.col("longer")))
    near = near.join(one.select(F.col("low").alias("s"), F.col("uuid").alias("canonical")), F.lower("shorter") == F.col("s")).join(one.select(F.col("low").alias("l"), F.col("uuid").alias("duplicate")), F.lower("longer") == F.col("l"))
    return keyed.unionByName(again.select("canonical", F.col("uuid").alias("duplicate"))).unionByName(near.select("canonical", "duplicate")).distinct()


def confirmed(entities: DataFrame, same: Callable[[Column, Column], Column] = plugins.same_entity, limit: int = MAX_MERGES) -> DataFrame:
    """The merges of one run: of the first 3 * limit candidates of the second tier by names, those that the judge confirms,
    `limit` at most. A run that is cut off goes on in the next."""
    first = generic_names(entities).orderBy("shorter", "longer").limit(3 * limit)
    return first.where(same(F.col("shorter"), F.col("longer"))).orderBy("shorter", "longer").limit(limit)


def merge_groups(pairs: DataFrame, entities: DataFrame | None = None, rounds: int = 30) -> DataFrame:
    """pairs(canonical, duplicate) -> (id, root): all that pairs connect gets one root, by entities(uuid, summary) the one
    with the longest summary, then the smallest uuid (without entities the smallest id). Each round takes the least label
    of all neighbours and of their labels; rounds are checkpointed, and it stops when nothing changes."""
    both = pairs.select(F.col("canonical").alias("a"), F.col("duplicate").alias("b"))
    both = saved(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = saved(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("root")).withColumnRenamed("a", "id"))
    for _ in range(rounds):
        low = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("root").alias("low"))
        hop = labels.join(low, "id").select("id", F.least("root", "low").alias("root"))
        far = hop.select(F.col("id").alias("root"), F.col("root").alias("far"))
        moved = hop.join(far, "root", "left").select("id", F.least("root", F.coalesce("far", "root")).alias("root"))
        new = saved(moved.join(labels.withColumnRenamed("root", "old"), "id").select("id", "root", (F.col("root") != F.col("old")).alias("moved")))
        labels = new.select("id", "root")
        if not new.where("moved").limit(1).count():
            break
    else:
        raise RuntimeError("merge groups did not settle")
    if entities is None:
        return labels
    known = labels.join(entities.select(F.col("uuid").alias("id"), F.length(F.coalesce("summary", F.lit(""))).alias("size")), "id", "left")
    best = known.groupBy("root").agg(F.min(F.struct(-F.coalesce("size", F.lit(0)), "id")).alias("best"))
    return labels.join(best, "root").select("id", F.col("best.id").alias("root"))


def repoint(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """edges(uuid, src, dst, …) onto the roots; edges that the merge turns into loops go, parallel facts stay."""
    for end in ("src", "dst"):
        roots = groups.select(F.col("id").alias(end), F.col("root").alias(f"{end}_root"))
        edges = edges.join(roots, end, "left")
    new = {end: F.coalesce(f"{end}_root", end) for end in ("src", "dst")}
    touched = F.col("src_root").isNotNull() | F.col("dst_root").isNotNull()
    kept = edges.withColumns({f"new_{k}": v for k, v in new.items()}).where(~(touched & (F.col("new_src") == F.col("new_dst"))))
    return kept.drop("src", "dst", "src_root", "dst_root").withColumnsRenamed({"new_src": "src", "new_dst": "dst"})


def repoint_mentions(mentions: DataFrame, groups: DataFrame) -> DataFrame:
    moved = mentions.join(groups.select(F.col("id").alias("entity_uuid"), "root"), "entity_uuid", "left")
    return moved.select("episode_uuid", F.coalesce("root", "entity_uuid").alias("entity_uuid")).distinct()
