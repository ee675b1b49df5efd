"""Queue preparation, block receipts, ingest-log matching and agent-run telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronolith.functions import text as T

LIVE = 4


def prepare(inbox: DataFrame, deferred: DataFrame, live: int = LIVE) -> DataFrame:
    """inbox(folder, content), deferred(folder) -> (folder, state): malformed notes are blocked, of all other names the
    oldest `live` are live and the rest held."""
    checked = inbox.withColumn("error", T.required_error(F.col("content")))
    blocked = checked.where("error is not null").select("folder", F.lit("blocked").alias("state"))
    pool = checked.where("error is null").select("folder").union(deferred.select("folder")).distinct().join(blocked.select("folder"), "folder", "left_anti")
    oldest = pool.orderBy("folder").limit(live).withColumn("first", F.lit(True))
    state = F.when(F.col("first"), "live").otherwise("held")
    return pool.join(F.broadcast(oldest), "folder", "left").select("folder", state.alias("state")).unionByName(blocked)


def counts_line(prepared: DataFrame, live: int = LIVE) -> DataFrame:
    n = lambda s: F.count_if(F.col("state") == s)
    return prepared.agg(F.format_string(f"pool=%d live=%d held=%d blocked=%d cap={live}", n("live") + n("held"), n("live"), n("held"), n("blocked")).alias("line"))


def receipts(requests: DataFrame, existing: DataFrame) -> DataFrame:
    """requests(slug, reason) against existing(slug, reason) -> (slug, result): blocked, already-blocked, conflict with
    another reason, or invalid slug or reason."""
    rows = requests.join(existing.select("slug", F.col("reason").alias("had")), "slug", "left")
    result = F.when(~F.coalesce(F.col("slug").rlike(T.BLOCKED_SLUG), F.lit(False)), "invalid-slug").when(~F.coalesce(F.col("reason").isin(*T.BLOCK_REASONS), F.lit(False)), "invalid-reason")
    return rows.select("slug", result.when(F.col("had").isNull(), "blocked").when(F.col("had") == F.col("reason"), "already-blocked").otherwise("conflict").alias("result"))


def wrapped(files: DataFrame) -> DataFrame:
    """files(path, …) below an inbox, with each bare note x.md put in a folder of its own, as x/x.md; README.md stays. Where
    that file is there already the bare one takes its place, as a move does."""
    bare = F.regexp_extract("path", r"^([^/]+)\.md$", 1)
    moves = (bare != "") & (bare != "README")
    rows = files.withColumn("moved", moves).withColumn("path", F.when(moves, F.concat(bare, F.lit("/"), bare, F.lit(".md"))).otherwise(F.col("path")))
    best = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("moved")))
    return rows.withColumn("nth", best).where("nth = 1").drop("nth")


def sections(lines: DataFrame) -> DataFrame:
    """lines(file, line_no, line) -> adds in_ingest: the current `## […]` heading, carried forward, is an ingest one."""
    head = F.when(F.col("line").startswith("## ["), F.col("line").rlike(r"^## \[[^\]]*\] (auto-)?ingest \|"))
    w = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("in_ingest", F.coalesce(F.last(head, ignorenulls=True).over(w), F.lit(False)))


def already_ingested(lines: DataFrame, slugs: DataFrame) -> DataFrame:
    """The slugs that stand, whole, in an ingest section: lines explode into slug-shaped words, which meet by equality."""
    words = sections(lines).where("in_ingest").select(F.explode(F.regexp_extract_all("line", F.lit("([A-Za-z0-9_-]+)"), F.lit(1))).alias("slug"))
    return slugs.join(words, "slug", "left_semi")


def tool_runs(events: DataFrame) -> DataFrame:
    """events(session, seq, ts, kind, call_id) -> (session, call_id, started, ended, seconds): each start with the next
    end of its call."""
    w = Window.partitionBy("session", "call_id").orderBy("seq")
    rows = events.where(F.col("kind").isin("tool_start", "tool_end"))
    rows = rows.withColumns({"next_kind": F.lead("kind").over(w), "ended": F.lead("ts").over(w)})
    return rows.where("kind = 'tool_start'").select("session", "call_id", F.col("ts").alias("started"), F.when(F.col("next_kind") == "tool_end", F.col("ended")).alias("ended")).withColumn("seconds", F.col("ended") - F.col("started"))


def run_totals(events: DataFrame) -> DataFrame:
    """events(session, seq, kind, tokens, cost, error) -> one row for each session."""
    n = lambda k: F.count_if(F.col("kind") == k)
    return events.groupBy("session").agg(
        F.sum("tokens").alias("tokens"), F.sum("cost").alias("cost"), n("turn_start").alias("turns"), n("tool_start").alias("tools"), n("auto_retry").alias("retries"),
        n("compaction").alias("compactions"), F.count_if(F.coalesce("error", F.lit("")) != "").alias("errors"), F.max_by("kind", "seq").alias("last_kind"),
    )
