"""Incremental ingestion by content hash: dispositions, batches, upgrades and removal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UPGRADES, BATCH, LISTED, BREAKER = 25, 15, 20, 3
PENDING = ("partial", "changed", "missing")


def with_mentions(episodes: DataFrame, mentions: DataFrame) -> DataFrame:
    """Adds mention_count, zero where there is none."""
    n = mentions.groupBy(F.col("episode_uuid").alias("uuid")).agg(F.count("*").alias("n"))
    return episodes.join(n, "uuid", "left").withColumn("mention_count", F.coalesce("n", F.lit(0))).drop("n")


def assess(notes: DataFrame, episodes: DataFrame) -> DataFrame:
    """notes(slug, ts, body), episodes(slug, uuid, complete, content_hash, content, mention_count, created_at) ->
    (slug, ts, disposition, upgrade_uuid), one row for each note.

    The newest complete episode decides: equal hash done; no hash, done (to be upgraded if its content equals); other
    hash changed. Without a complete one, the newest with mentions makes it done (to be upgraded if its hash or content
    equals). Else partial, or missing if there is no episode at all. One aggregation by slug picks both candidates."""
    e = F.struct("created_at", "uuid", "content_hash", "content")
    newest = episodes.groupBy("slug").agg(
        F.max(F.when(F.col("complete").eqNullSafe(True), e)).alias("done"),
        F.max(F.when(~F.col("complete").eqNullSafe(True) & (F.col("mention_count") > 0), e)).alias("mentioned"),
    )
    rows = notes.join(newest.withColumn("any", F.lit(True)), "slug", "left").withColumn("hash", F.sha2("body", 256))
    same = lambda c: F.col(f"{c}.content_hash").isNull() & F.col(f"{c}.content").eqNullSafe(F.col("body")) & F.col(f"{c}.content").isNotNull()
    has = F.col("done").isNotNull()
    disposition = (
        F.when(F.col("any").isNull(), "missing")
        .when(has & (F.col("done.content_hash").isNull() | (F.col("done.content_hash") == F.col("hash"))), "done")
        .when(has, "changed")
        .when(F.col("mentioned").isNotNull(), "done")
        .otherwise("partial")
    )
    upgrade = F.when(has & same("done"), F.col("done.uuid")).when(~has & same("mentioned"), F.col("mentioned.uuid"))
    return rows.select("slug", "ts", disposition.alias("disposition"), upgrade.alias("upgrade_uuid"))


def pending(assessed: DataFrame) -> DataFrame:
    return assessed.where(F.col("disposition").isin(*PENDING))


def oldest(df: DataFrame, n: int) -> DataFrame:
    """The first n by time, then slug: a top-k, not a total sort."""
    return df.orderBy("ts", "slug").limit(n)


def upgrades(assessed: DataFrame, limit: int = UPGRADES) -> DataFrame:
    return oldest(assessed.where("upgrade_uuid is not null"), limit)


def upgrade_episodes(episodes: DataFrame, chosen: DataFrame, notes: DataFrame, now: Column) -> DataFrame:
    """Marks the chosen episodes complete with their note's hash; a completion time that is set stays."""
    marks = chosen.join(notes.select("slug", F.sha2("body", 256).alias("new_hash")), "slug").select(F.col("upgrade_uuid").alias("uuid"), "new_hash")
    done = episodes.join(marks, "uuid", "left")
    hit = F.col("new_hash").isNotNull()
    return done.withColumns({
        "complete": F.when(hit, True).otherwise(F.col("complete")), "content_hash": F.coalesce("new_hash", "content_hash"),
        "completed_at": F.when(hit, F.coalesce("completed_at", now)).otherwise(F.col("completed_at")),
    }).drop("new_hash")


def remove_episodes(episodes: DataFrame, mentions: DataFrame, facts: DataFrame, slugs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Without the episodes of the given slugs, their mentions, and the facts that only they carried."""
    gone = episodes.join(slugs.select("slug"), "slug", "left_semi").select("uuid")
    kept_facts = facts.withColumn("e", F.explode_outer("episodes")).join(gone.withColumnRenamed("uuid", "e"), "e", "left_anti")
    alive = kept_facts.select("uuid").distinct()
    return episodes.join(gone, "uuid", "left_anti"), mentions.join(gone.withColumnRenamed("uuid", "episode_uuid"), "episode_uuid", "left_anti"), facts.join(alive, "uuid", "left_semi")


def rollup(assessed: DataFrame, episodes: DataFrame) -> DataFrame:
    """One row: notes, done, partial, changed, missing, pending, episodes, completed, and the watermark."""
    n = lambda d: F.count_if(F.col("disposition") == d).alias(d)
    a = assessed.agg(F.count("*").alias("notes"), n("done"), n("partial"), n("changed"), n("missing"), F.count_if(F.col("disposition").isin(*PENDING)).alias("pending"))
    e = episodes.agg(F.count("*").alias("episodes"), F.count_if(F.col("complete").eqNullSafe(True)).alias("completed"), F.coalesce(F.max("completed_at").cast("string"), F.lit("none")).alias("watermark"))
    return a.crossJoin(e)


def breaker(runs: DataFrame, *key: str, limit: int = BREAKER) -> DataFrame:
    """runs(*key, seq, ok) -> adds streak (failures in a row up to here) and stopped (the breaker opened before this
    run): islands of failures between successes."""
    w = Window.partitionBy(*key).orderBy("seq")
    island = runs.withColumn("island", F.sum(F.col("ok").cast("int")).over(w))
    streak = island.withColumn("streak", F.when(F.col("ok"), 0).otherwise(F.sum((~F.col("ok")).cast("int")).over(Window.partitionBy(*key, "island").orderBy("seq"))))
    opened = F.max((F.col("streak") >= limit).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return streak.withColumn("stopped", F.coalesce(opened, F.lit(0)) == 1).drop("island")


def retries(notes: DataFrame, seen: DataFrame) -> DataFrame:
    """notes(slug, capture_hash) that an earlier seen(folder, capture_hash, ord) holds under the same slug -> (slug,
    folder), the first by ord."""
    hit = notes.join(seen, "capture_hash").where(F.col("folder").endswith(F.concat(F.lit("-"), F.col("slug"))))
    return hit.groupBy("slug", "capture_hash").agg(F.min_by("folder", "ord").alias("folder")).select("slug", "folder")


def unseen(notes: DataFrame, written: DataFrame) -> DataFrame:
    """notes(slug, body, …) that are not among written(slug, content_hash), each once, with their content_hash."""
    hashed = notes.withColumn("content_hash", F.sha2("body", 256)).dropDuplicates(["slug", "content_hash"])
    return hashed.join(written.select("slug", "content_hash"), ["slug", "content_hash"], "left_anti")


def note(episodes: DataFrame, slug: str) -> DataFrame:
    """(slug, content, valid_at) of a note's newest episode that has content; no row if there is none."""
    found = episodes.where((F.col("slug") == slug) & F.col("content").isNotNull())
    return found.orderBy(F.desc("created_at"), F.desc("uuid")).limit(1).select("slug", "content", F.col("created_at").alias("valid_at"))
