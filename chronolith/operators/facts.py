"""Bitemporal facts: intervals, what is current, what changed, what was true at an instant.

facts(uuid, subject, object, fact, valid_at, invalid_at, ...): valid_at is event time, invalid_at closes the half-open
interval [valid_at, invalid_at) and is null while the fact holds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import dealt

NEW_LIMIT, OLD_LIMIT, ENTITY_LIMIT, HITS, KEPT = 25, 15, 25, 15, 10


def close_intervals(events: DataFrame, *key: str) -> DataFrame:
    """invalid_at = the next valid_at of the same key; equal times give empty intervals, which no instant meets."""
    return events.withColumn("invalid_at", F.lead("valid_at").over(Window.partitionBy(*key).orderBy("valid_at", "uuid")))


def is_current() -> Column:
    """A future invalid_at counts as superseded already."""
    return F.col("invalid_at").isNull()


def as_of(facts: DataFrame, at: Column) -> DataFrame:
    return facts.where((F.col("valid_at") <= at) & (F.col("invalid_at").isNull() | (F.col("invalid_at") > at)))


def as_of_join(points: DataFrame, facts: DataFrame, key: str, at: str) -> DataFrame:
    """Each point with all facts of its key that hold at its time, which may overlap: equi-join on the key, then the interval.
    It meets all points of a key with all its facts; where a key's facts don't overlap, as those of `close_intervals`,
    `as_of_merge` gives the same in one pass."""
    return points.join(facts, key).where((F.col("valid_at") <= F.col(at)) & (F.col("invalid_at").isNull() | (F.col("invalid_at") > F.col(at))))


def as_of_merge(points: DataFrame, facts: DataFrame, key: str, at: str, days: int = 90, rows: int | None = None) -> DataFrame:
    """Each point with the fact of its key that holds at its time, for keys whose facts don't overlap: points and facts are
    laid in one line by key and time, and the last fact that began is carried forward. A key's line is cut every `days` days,
    so that a hot key is no single group; the fact that stands before a piece is carried to it from a table with one row
    for each key and piece. rows: about how many points and facts there are, if known; else they are counted. Of facts that begin together the last by uuid counts, as the others are empty. Points and facts
    without key or time match nothing; a point that no fact holds for has no row; other columns need different names."""
    own = [c for c in facts.columns if c != key]
    if clash := set(own) & set(points.columns):
        raise ValueError(f"points and facts both have {sorted(clash)}")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    piece = F.floor(F.col("t") / (days * 86_400_000_000)).alias("piece")
    told = facts.where(F.col(key).isNotNull() & F.col("valid_at").isNotNull()).select(F.col(key).alias("k"), micros("valid_at").alias("t"), F.struct(micros("valid_at").alias("begun"), "uuid", micros("invalid_at").alias("ended"), F.struct(*own).alias("own")).alias("fact")).withColumn("piece", piece)
    asked = points.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(F.col(key).alias("k"), micros(at).alias("t"), F.struct(*[c for c in points.columns if c != key]).alias("point")).withColumn("piece", piece)
    # only facts are ordered to find a piece's last one; of the points, pieces that have some are enough
    ends = told.groupBy("k", "piece").agg(F.max_by("fact", F.struct("t", "fact.uuid")).alias("last"))
    pieces = ends.unionByName(asked.select("k", "piece").distinct().withColumn("asked", F.lit(True)), allowMissingColumns=True)
    before = F.last("last", ignorenulls=True).over(Window.partitionBy("k").orderBy("piece").rangeBetween(Window.unboundedPreceding, -1))
    carried = pieces.withColumn("before", before).where("asked").select("k", "piece", "before")
    line = dealt(told.unionByName(asked, allowMissingColumns=True), "k", "piece", count=rows if rows is not None else points.count() + facts.count())
    # a fact stands before the points of its own time
    passed = Window.partitionBy("k", "piece").orderBy("t", F.col("point").isNotNull(), "fact.uuid").rowsBetween(Window.unboundedPreceding, 0)
    met = line.withColumn("inside", F.last("fact", ignorenulls=True).over(passed)).where("point is not null").join(carried, ["k", "piece"])
    held = met.withColumn("f", F.coalesce("inside", "before")).where(F.col("f").isNotNull() & (F.col("f.ended").isNull() | (F.col("f.ended") > F.col("t"))))
    return held.select(F.col("k").alias(key), *[F.col("point")[c].alias(c) for c in points.columns if c != key], *[F.col("f.own")[c].alias(c) for c in own])


def trailing(df: DataFrame, column: str, now: Column, days: int) -> DataFrame:
    """Rows of the last `days` days; the lower bound is in, and there is no upper one."""
    return df.where(F.col(column) >= now - F.make_dt_interval(F.lit(days)))


def changes(facts: DataFrame, subject: str, now: Column, days: int) -> DataFrame:
    """(kind, fact, valid_at, invalid_at): at most 25 new and 15 superseded distinct facts about a subject in the window,
    newest first by the times' text. subject: in the fact or an endpoint's name, in any case."""
    wanted = F.lit(subject.lower())
    mine = facts.where(F.lower("fact").contains(wanted) | F.lower("subject_name").contains(wanted) | F.lower("object_name").contains(wanted))

    def part(column: str, kind: str, limit: int) -> DataFrame:
        rows = trailing(mine, column, now, days).select("fact", F.col("valid_at").cast("string").alias("valid_at"), F.col("invalid_at").cast("string").alias("invalid_at"))
        return rows.distinct().orderBy(F.col(column).desc_nulls_first(), "fact", "valid_at").limit(limit).select(F.lit(kind).alias("kind"), "*")

    return part("valid_at", "new", NEW_LIMIT).unionByName(part("invalid_at", "superseded", OLD_LIMIT))


def neighbourhood(edges: DataFrame) -> DataFrame:
    """(node, other, …): each edge(src, dst, …) from both ends."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("other"), *rest).unionByName(edges.select(F.col("dst").alias("node"), F.col("src").alias("other"), *rest))


def entity_facts(entities: DataFrame, edges: DataFrame, name: str, limit: int = ENTITY_LIMIT) -> DataFrame:
    """(uuid, name, fact, other, valid_at): the current facts of all entities of that name; the row's uuid is the
    smallest one's; unknown times first, then newest first."""
    same = entities.where(F.lower("name") == name.lower())
    pick = same.agg(F.min("uuid").alias("picked"), F.min_by("name", "uuid").alias("picked_name"))
    near = neighbourhood(edges.where(is_current() & F.col("fact").isNotNull())).join(F.broadcast(same.select(F.col("uuid").alias("node"))), "node")
    named = near.join(entities.select(F.col("uuid").alias("other"), F.col("name").alias("other_name")), "other")
    top = named.select("fact", F.col("other_name").alias("other"), "valid_at", F.col("uuid").alias("edge")).orderBy(F.col("valid_at").desc_nulls_first(), "edge", "other").limit(limit)
    return top.crossJoin(pick).select(F.col("picked").alias("uuid"), F.col("picked_name").alias("name"), "fact", "other", "valid_at", "edge")


def current_of_hits(hits: DataFrame) -> DataFrame:
    """Of the first 15 hits(rank, …) the current ones, 10 at most: superseded hits use up places, as they should."""
    return hits.orderBy("rank").limit(HITS).where(is_current()).orderBy("rank").limit(KEPT)


def provenance(facts: DataFrame, episodes: DataFrame) -> DataFrame:
    """Adds source_slug: the name of the fact's first episode, blank if there is none."""
    names = episodes.select(F.col("uuid").alias("first_episode"), F.col("name").alias("source_slug"))
    first = facts.withColumn("first_episode", F.try_element_at("episodes", F.lit(1)))
    return first.join(names, "first_episode", "left").withColumn("source_slug", F.coalesce("source_slug", F.lit(""))).drop("first_episode")


def density(facts: DataFrame, top: int) -> DataFrame:
    """(entity, n): the entities with most current facts, counted at both ends."""
    ends = facts.where(is_current()).select(F.explode(F.array("src", "dst")).alias("entity"))
    return ends.groupBy("entity").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "entity").limit(top)


def judge_input(facts: DataFrame, limit: int = 40) -> DataFrame:
    """The first 40 current dated facts of each subject, oldest first."""
    w = Window.partitionBy("subject").orderBy(F.col("valid_at").asc_nulls_last(), "uuid")
    return facts.where("valid_at is not null").withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= limit)


def contradictions(facts: DataFrame) -> DataFrame:
    """(subject, older, newer, closes_at): pairs of one subject that differ in object and time. The older of a pair is
    to close when the newer begins."""
    rows = judge_input(facts)
    a, b = (rows.select("subject", *(F.col(c).alias(f"{c}_{x}") for c in ("uuid", "object", "valid_at"))) for x in "ab")
    pairs = a.join(b, "subject").where("object_a <> object_b and valid_at_a < valid_at_b")
    return pairs.select("subject", F.col("uuid_a").alias("older"), F.col("uuid_b").alias("newer"), F.col("valid_at_b").alias("closes_at"))


def judged_contradictions(facts: DataFrame, judge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """As `contradictions`, by a judge of one's own: it gets (subject, facts), the listed facts in order as structs of uuid,
    object, fact and valid_at, and returns pairs(subject, i, j) of places in that list, from 0. Pairs that name no two facts,
    and facts of one time, which do not show which to close, are left out; a pair counts once in whatever order."""
    listed = judge_input(facts).groupBy("subject").agg(F.sort_array(F.collect_list(F.struct((F.col("rn") - 1).alias("place"), "uuid", "object", "fact", "valid_at"))).alias("listed"))
    said = judge(listed.select("subject", F.transform("listed", lambda f: F.struct(f["uuid"].alias("uuid"), f["object"].alias("object"), f["fact"].alias("fact"), f["valid_at"].alias("valid_at"))).alias("facts")))
    met = said.join(listed, "subject").select("subject", F.get("listed", F.col("i")).alias("a"), F.get("listed", F.col("j")).alias("b"))
    first = F.when(F.col("a.valid_at") < F.col("b.valid_at"), F.struct("a", "b")).when(F.col("b.valid_at") < F.col("a.valid_at"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    pairs = met.withColumn("p", first).where("p is not null")
    return pairs.select("subject", F.col("p.a.uuid").alias("older"), F.col("p.b.uuid").alias("newer"), F.col("p.b.valid_at").alias("closes_at")).distinct()


def close_contradicted(facts: DataFrame, pairs: DataFrame, now: Column) -> DataFrame:
    """facts with invalid_at and expired_at set where a pair closes them; of several pairs the earliest closing counts."""
    closing = pairs.groupBy(F.col("older").alias("uuid")).agg(F.min("closes_at").alias("closes_at"))
    done = facts.join(closing, "uuid", "left")
    return done.withColumns({
        "invalid_at": F.coalesce("closes_at", "invalid_at"),
        "expired_at": F.when(F.col("closes_at").isNotNull(), now).otherwise(F.col("expired_at")) if "expired_at" in facts.columns else F.when(F.col("closes_at").isNotNull(), now),
    }).drop("closes_at")
