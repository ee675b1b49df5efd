"""Operational snapshot, alert policy, health checks, gauges and time-series alert rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bounds of the alert policy.
PENDING_HOURS, COMMUNITY_DAYS = 2, 8


def queue_summary(queue: DataFrame, now: Column) -> DataFrame:
    """queue(queue, slug, ts) -> (queue, count, oldest_age_seconds)."""
    g = queue.groupBy("queue").agg(F.count("*").alias("count"), F.min("ts").alias("oldest"))
    return g.select("queue", "count", F.greatest(F.lit(0), F.unix_seconds(now) - F.unix_seconds("oldest")).alias("oldest_age_seconds"))


def newest_note(*queues: DataFrame) -> DataFrame:
    """(slug, ts) of the newest note over all queues."""
    rows = queues[0].select("slug", "ts")
    for q in queues[1:]:
        rows = rows.unionByName(q.select("slug", "ts"))
    return rows.where("ts is not null").agg(F.max(F.struct("ts", "slug")).alias("m")).select("m.slug", "m.ts")


def listed(queue: DataFrame, limit: int) -> DataFrame:
    """The first `limit` entries of each queue, oldest first, unknown times last; and whether there are more. The rank alone
    is windowed, so that each task keeps `limit` rows of a queue before the shuffle."""
    order = Window.partitionBy("queue").orderBy(F.col("ts").asc_nulls_last(), "slug")
    first = queue.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= limit)
    sizes = queue.groupBy("queue").agg((F.count("*") > limit).alias("truncated"))
    return first.join(sizes, first["queue"].eqNullSafe(sizes["queue"])).drop(sizes["queue"])


def snapshot(components: DataFrame, index: DataFrame, queues: DataFrame, ingest: DataFrame, communities: DataFrame, usage: DataFrame) -> DataFrame:
    """One row with nested sections from one-row frames (queues and components: one row for each)."""
    c = components.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("component", "ready")))).alias("components"), F.bool_and("ready").alias("ok"))
    q = queues.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("queue", F.struct("count", "oldest_age_seconds"))))).alias("queues"))
    one = lambda df, name: df.select(F.struct("*").alias(name))
    out = c.crossJoin(q)
    for df, name in ((index, "index"), (ingest, "ingest"), (communities, "communities"), (usage, "usage_24h")):
        out = out.crossJoin(one(df, name))
    return out


def rules(df: DataFrame, *checks: tuple[str, str, Column, Column]) -> DataFrame:
    """(severity, rule, msg) for each check(severity, rule, condition, msg) that a row meets; a null condition is unmet."""
    found = F.array(*[F.when(F.coalesce(on, F.lit(False)), F.struct(F.lit(s).alias("severity"), F.lit(r).alias("rule"), msg.alias("msg"))) for s, r, on, msg in checks])
    return df.select(F.inline(F.filter(found, lambda x: x.isNotNull())))


def alerts(status: DataFrame, unknown: bool = False) -> DataFrame:
    """status(wiki_ready, graph_ready, git_ready, ingest_error, pending, lag_seconds, community_count, community_age,
    blocked, review) -> (severity, rule, msg). What a status does not say is not ready and 0; unknown: it meets no rule."""
    ready = [("fail", f"{c}_ready", ~F.coalesce(F.col(f"{c}_ready"), F.lit(None if unknown else False)), F.lit(f"component {c} not ready")) for c in ("wiki", "graph", "git")]
    n = lambda c: F.coalesce(F.col(c), F.lit(None if unknown else 0))
    return rules(
        status, *ready,
        ("fail", "ingest_error", F.coalesce("ingest_error", F.lit("")) != "", F.concat(F.lit("ingest status unavailable: "), F.col("ingest_error"))),
        ("fail", "ingest_lag", (n("pending") > 0) & (n("lag_seconds") > PENDING_HOURS * 3600), F.format_string("%d pending", n("pending"))),
        ("fail", "no_communities", n("community_count") == 0, F.lit("communities: none")),
        ("fail", "communities_stale", (n("community_count") != 0) & (F.col("community_age") > COMMUNITY_DAYS * 86400), F.lit("communities stale")),
        ("warn", "blocked", n("blocked") > 0, F.format_string("blocked notes awaiting audit: %d", n("blocked"))),
        ("warn", "review", n("review") > 0, F.format_string("review queue open: %d", n("review"))),
    )


def gauges(status: DataFrame, unknown: bool = False) -> DataFrame:
    """(name, value): the 13 gauges; an age that never was is infinite. What a status does not say is 0; unknown: it stays
    null, and makes no age infinite."""
    n = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(None if unknown else 0.0))
    inf = F.lit(float("inf"))
    values = {
        "wiki_index_ready": n("wiki_ready"), "wiki_index_degraded": n("degraded"), "wiki_pages_indexed": n("pages_indexed"),
        "wiki_index_age_seconds": F.coalesce(F.col("index_age").cast("double"), F.when(n("wiki_ready") == 0, inf).otherwise(0.0)),
        "graph_ready": n("graph_ready"), "inbox_notes": n("inbox"), "deferred_notes": n("deferred"), "blocked_notes": n("blocked"), "review_queue_open": n("review"),
        "ingest_pending_notes": n("pending"), "ingest_partial_notes": n("partial"), "ingest_lag_seconds": n("lag_seconds"),
        "community_age_seconds": F.coalesce(F.col("community_age").cast("double"), F.when((n("graph_ready") == 1) & (n("community_count") == 0), inf).otherwise(0.0)),
    }
    return status.select(F.inline(F.array(*[F.struct(F.lit(k).alias("name"), v.alias("value")) for k, v in values.items()])))


def exposition(metrics: DataFrame) -> DataFrame:
    """metrics(name, kind, labels map, value) -> one text in the Prometheus exposition format: for each name its type, then
    its samples by their labels. Names and labels are few, so the text is one row."""
    value = F.when(F.col("value") == float("inf"), "+Inf").otherwise(F.col("value").cast("string"))
    pairs = F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e.key, F.lit('="'), e.value, F.lit('"')))
    labels = F.when(F.size(pairs) > 0, F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))).otherwise("")
    samples = metrics.groupBy("name").agg(F.first("kind").alias("kind"), F.array_join(F.array_sort(F.collect_list(F.concat("name", labels, F.lit(" "), value))), "\n").alias("lines"))
    block = F.concat(F.lit("# TYPE "), "name", F.lit(" "), "kind", F.lit("\n"), "lines")
    return samples.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", block.alias("block")))), lambda x: x.block), "\n").alias("text"))


#: Hours and counts of the health checks.
FRESH_HOURS, GRACE_HOURS, INDEX_HOURS, INBOX_HOURS, STALL_DAYS, LAG_DAYS, DEFERRED_MAX, CHECKED = 48, 2, 6, 24, 3, 7, 200, 25


def health(notes: DataFrame, episodes: DataFrame, pages: DataFrame, probes: DataFrame, now: Column, curated_at: Column) -> DataFrame:
    """notes(slug, ts, queue), episodes(slug, complete, mention_count), pages(name), probes(facts, entities, confidence,
    answer, none_confidence, none_answer, none_escalate, results: one row) and the time of the last change to the curated
    notes -> (check, rule, severity, ok):
    A a note is at most 48 h old; B the newest 25 notes aged 2 to 48 h are complete or mentioned; C nothing waits in the
    inbox over 24 h, notes that arrived within 3 d are curated (the curated notes changed within 3 d), nothing pending is
    over 7 d old, at most 200 are deferred; D a known question finds facts or entities, an answer of some confidence and
    pages, and nonsense is not found and escalated; E the newest curated note over 6 h old is a page. A check without
    anything to check is ok, but for A."""
    aged = notes.where("ts is not null").withColumn("hours", (F.unix_seconds(now) - F.unix_seconds("ts")) / 3600)
    waiting = F.col("queue").isin("inbox", "deferred")
    stalled = (F.unix_seconds(now) - F.unix_seconds(curated_at)) / 86400 > STALL_DAYS
    row = aged.agg(
        F.coalesce(F.min("hours") <= FRESH_HOURS, F.lit(False)).alias("write_path"), (F.count_if((F.col("queue") == "inbox") & (F.col("hours") > INBOX_HOURS)) == 0).alias("inbox_age"),
        (~((F.count_if(waiting & (F.col("hours") <= STALL_DAYS * 24)) > 0) & F.coalesce(F.bool_or(stalled), F.lit(False)))).alias("stalled"),
        (F.count_if(waiting & (F.col("hours") > LAG_DAYS * 24)) == 0).alias("pending_age"), (F.count_if(F.col("queue") == "deferred") <= DEFERRED_MAX).alias("deferred_count"),
    )
    due = aged.where(F.col("hours").between(GRACE_HOURS, FRESH_HOURS)).orderBy(F.desc("ts"), "slug").limit(CHECKED)
    done = episodes.where(F.col("complete").eqNullSafe(True) | (F.col("mention_count") > 0)).select("slug")
    lost = due.join(done, "slug", "left_anti").agg((F.count("*") == 0).alias("ingestion"))
    newest = aged.where((F.col("queue") == "curated") & (F.col("hours") >= INDEX_HOURS)).agg(F.max_by("slug", F.struct("ts", "slug")).alias("name"))
    indexed = newest.join(pages.select("name").withColumn("there", F.lit(True)), "name", "left").select((F.col("name").isNull() | F.col("there").isNotNull()).alias("indexing"))
    said = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    exposed = probes.select(
        (F.col("facts") + F.col("entities") > 0).alias("search"), (F.col("confidence").isin("high", "medium") & said("answer")).alias("answer"),
        ((F.col("none_confidence") == "not_found") & ~said("none_answer") & F.col("none_escalate")).alias("nonsense"), (F.col("results") > 0).alias("pages"),
    )
    wide = row.crossJoin(lost).crossJoin(exposed).crossJoin(indexed)
    checks = {"write_path": "A", "ingestion": "B", "inbox_age": "C", "stalled": "C", "pending_age": "C", "deferred_count": "C", "search": "D", "answer": "D", "nonsense": "D", "pages": "D", "indexing": "E"}
    return wide.select(F.inline(F.array(*[F.struct(F.lit(k).alias("check"), F.lit(r).alias("rule"), F.lit("warn" if r == "deferred_count" else "fail").alias("severity"), F.coalesce(F.col(r), F.lit(False)).alias("ok")) for r, k in checks.items()])))


def communities(nodes: DataFrame, now: Column) -> DataFrame:
    """nodes(created_at, …) of communities -> one row: count, newest, age_seconds (null if there is none)."""
    row = nodes.agg(F.count("*").alias("count"), F.max("created_at").alias("newest"))
    return row.withColumn("age_seconds", F.greatest(F.lit(0), F.unix_seconds(now) - F.unix_seconds("newest")))


#: Rule, condition over a sample's columns, hold in seconds, severity.
SERIES_RULES = (
    ("server_down", "coalesce(up, 0) = 0", 300, "critical"),
    ("index_unready", "index_ready = 0", 600, "critical"),
    ("index_degraded", "index_degraded = 1", 900, "warning"),
    ("index_stale", "index_age > 900", 600, "warning"),
    ("graph_not_ready", "graph_ready = 0", 600, "critical"),
    ("ingest_lag", "pending > 0 and lag > 7200", 900, "critical"),
    ("blocked_sustained", "blocked > 0", 86400, "warning"),
    ("curator_backlog", "inbox + deferred + review > 100", 21600, "warning"),
    ("answer_quality", "calls_10m >= 20 and bad_10m / greatest(calls_10m, 0.001) > 0.05", 600, "warning"),
    ("note_drop_failures", "drop_failures_10m > 0", 300, "critical"),
    ("communities_stale", "community_age > 691200", 1800, "warning"),
)


def series_alerts(samples: DataFrame, rules_: tuple = SERIES_RULES, width: int = 86_400) -> DataFrame:
    """samples(at seconds, …) -> (at, rule, severity) where a rule's condition held at every sample of the hold before,
    and samples reach back that far. Within pieces of `width` seconds the last sample that was off is windowed; what
    stands before a piece is carried from a table with one row for each rule and piece, so that no task gets the whole
    history of a rule."""
    flat = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(s).alias("severity"), F.lit(h).alias("hold"), F.coalesce(F.expr(c), F.lit(False)).alias("on")) for r, c, h, s in rules_])
    rows = samples.select("at", F.floor(F.col("at") / width).alias("piece"), F.inline(flat))
    off = F.when(~F.col("on"), F.col("at"))
    pieces = rows.groupBy("rule", "piece").agg(F.max(off).alias("off"), F.min("at").alias("start"))
    earlier = Window.partitionBy("rule").orderBy("piece")
    carried = pieces.select("rule", "piece", F.max("off").over(earlier.rowsBetween(Window.unboundedPreceding, -1)).alias("before"), F.min("start").over(earlier).alias("first"))
    own = F.max(off).over(Window.partitionBy("rule", "piece").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    held = rows.withColumn("own", own).where("on").join(carried, ["rule", "piece"])
    prior = F.coalesce(F.greatest("own", "before"), F.col("first") - 1)
    return held.where(F.col("at") - prior > F.col("hold")).select("at", "rule", "severity")


def scheduler(jobs: DataFrame, now: Column) -> DataFrame:
    """jobs(job, last_success seconds, active, suspended, failed, succeeded) -> one row for each job."""
    return jobs.groupBy("job").agg((now - F.max("last_success")).alias("since_success"), *[F.max(c).alias(c) for c in ("active", "suspended", "failed", "succeeded")])
