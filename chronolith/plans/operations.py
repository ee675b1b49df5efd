"""Queries over use, health, pages and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronolith.functions import text as T
from chronolith.operators import lint, pages, report, status, usage

from .registry import query
from .workload import cte, table, view

TOOLS = "('wiki_search', 'wiki_get', 'graph_answer', 'graph_search')"
FAILED = "(coalesce(confidence, '') = 'error' or coalesce(outcome, '') = 'error' or coalesce(error, '') <> '')"
LOG = cte("query_log")


def log(spark, sf):
    return view(spark, sf, "query_log").withColumn("ts", F.col("ts").cast("timestamp"))


@query("A3 A9 T8f D10 P36", LOG + f"select case when tool in {TOOLS} then tool else 'other' end as tool, count(*) as calls, count(*) filter {FAILED.replace('(coal', '(where coal', 1)} as errors, count(*) filter (cached) as cache_hits from query_log where not test group by 1")
def usage_by_tool(spark, sf):
    return usage.by_tool(log(spark, sf))


@query("A3", LOG + "select v.confidence, count(l.event_id) as n from (values ('high'), ('medium'), ('low'), ('not_found'), ('error')) v(confidence) left join (select * from query_log where not test) l on l.confidence = v.confidence group by 1")
def usage_by_confidence(spark, sf):
    return usage.by_confidence(log(spark, sf))


@query("A10", LOG + """
, a as (select *, confidence in ('high', 'medium', 'low') and answer_tokens > 0 as good from query_log where not test and tool = 'graph_answer')
, m as (select count(*) as calls, count(*) filter (cached) as cache_hits, median(answer_tokens) filter (good) as median_answer, median(packet_tokens) filter (good) as median_packet, count(*) filter (confidence in ('not_found', 'error')) as lost from a)
select calls, cache_hits, median_answer, median_packet, round_even(median_packet / median_answer, 1) as compression, round_even(lost / calls, 3) as not_found_rate from m""")
def usage_answer_health(spark, sf):
    return usage.answer_health(log(spark, sf))


@query("A9", LOG + "select " + ", ".join(f"count(*) filter (tool = '{t}'{' and not test' if t.startswith('graph_') else ''}) as {t}_calls" for t in ("wiki_search", "wiki_get", "graph_search", "graph_answer", "graph_entity")) + " from query_log")
def usage_split(spark, sf):
    return usage.usage_split(log(spark, sf))


GAPS = LOG + """
, g as (select 0 as part, 'wiki' as src, ts, event_id, query as q, round_even(coalesce(score, 0), 3) as best_score from query_log where tool = 'wiki_search' and (n = 0 or score < 0.45)
  union all select 1, 'graph', ts, event_id, query, null from query_log where tool = 'graph_search' and n = 0 and not test
  union all select 2, 'answer', ts, event_id, query, null from query_log where tool = 'graph_answer' and confidence in ('not_found', 'error') and not test)
, k as (select *, substr(trim(regexp_replace(lower(q), '\\s+', ' ', 'g')), 1, 60) as key from g)
, gaps as (select src, key, q, best_score from (select *, row_number() over (partition by key order by part, ts, event_id) as rn from k where key <> '') where rn = 1) """


@query("R5 A21 U9", GAPS + "select src, key, q, best_score from gaps")
def usage_gaps(spark, sf):
    """Questions that found nothing useful, each once."""
    return usage.gaps(log(spark, sf))


PRIOR = "select concat('last week: what is item ', range, ' and more') as text from range(1, 97, 3)"


def prior(spark):
    return spark.range(1, 97, 3).select(F.concat(F.lit("last week: what is item "), "id", F.lit(" and more")).alias("text"))


@query("J15", GAPS + f", p as ({PRIOR}) select key from gaps where exists (select 1 from p where contains(lower(text), substr(trim(regexp_replace(lower(q), '\\s+', ' ', 'g')), 1, 40)))")
def usage_recurring_gaps(spark, sf):
    return usage.recurring(usage.gaps(log(spark, sf)), prior(spark)).select("key")


@query("J15", GAPS + f", p as ({PRIOR}) select key from gaps where exists (select 1 from p where contains(lower(text), substr(trim(regexp_replace(lower(q), '\\s+', ' ', 'g')), 1, 40)))")
def usage_recurring_by_seeds(spark, sf):
    """The same by an equi-join on the beginnings of windows."""
    return usage.recurring_by_seeds(usage.gaps(log(spark, sf)), prior(spark)).select("key")


@query("R6", GAPS + f""", p as ({PRIOR}), r as (select count(*) as recurring from gaps where exists (select 1 from p where contains(lower(text), substr(trim(regexp_replace(lower(q), '\\s+', ' ', 'g')), 1, 40))))
, s as (select count(*) as graph_searches from query_log where tool = 'graph_search' and not test), z as (select count(*) as zero_hits from gaps where src = 'graph')
select *, graph_searches >= 200 as learned_ranking, recurring >= 5 as gap_classifier, zero_hits >= 15 as episode_embeddings from s, z, r""")
def usage_triggers(spark, sf):
    g = usage.gaps(log(spark, sf))
    return usage.triggers(log(spark, sf), g, usage.recurring(g, prior(spark)))


@query("A11", LOG + "select query as name, count(*) as n from query_log where tool = 'wiki_get' group by 1 order by n desc, name limit 10")
def usage_most_fetched(spark, sf):
    return usage.most_fetched(log(spark, sf))


OUTCOME = f"case when {FAILED} then 'error' when confidence = 'not_found' then 'not_found' when outcome = 'degraded' then 'degraded' else 'ok' end"


@query("A17 P19 P20", LOG + f"""
, t as (select unnest(['wiki_search', 'wiki_get', 'wiki_backlinks', 'wiki_note_drop', 'graph_answer', 'graph_search', 'graph_get_note', 'graph_entity', 'graph_current_facts', 'graph_changes', 'memory_status', 'other']) as tool)
, o as (select unnest(['ok', 'error', 'not_found', 'degraded']) as outcome), e as (select case when tool in {TOOLS} then tool else 'other' end as tool, {OUTCOME} as outcome from query_log)
select t.tool, o.outcome, (select count(*) from e where e.tool = t.tool and e.outcome = o.outcome) as n from t, o""")
def usage_counters(spark, sf):
    return usage.counters(log(spark, sf))


@query("A18", LOG + "select tool, count(*) as calls, round(quantile_cont(duration_ms, 0.5), 6) as p50, round(quantile_cont(duration_ms, 0.95), 6) as p95 from query_log group by 1")
def usage_durations(spark, sf):
    return usage.durations(log(spark, sf), "tool").select("tool", "calls", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


@query("A18 D19", LOG + ", b as (select unnest([0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0, 1e300]) as le) select tool, case when le > 100 then '+Inf' else format('{}', cast(le as double)) end as le, count(*) filter (duration_ms / 1000 <= b.le) as n from query_log, b group by tool, b.le")
def usage_histogram(spark, sf):
    return usage.histogram(log(spark, sf), "tool")


@query("W9 M3", LOG + f"""select event_id, count(*) over w as calls, cast(sum(case when {FAILED} then 1 else 0 end) over w as bigint) as bad from query_log window w as (partition by tool order by cast(floor(epoch(ts)) as bigint) range between 600 preceding and current row)""")
def usage_rolling_rate(spark, sf):
    return usage.rolling_rate(log(spark, sf)).select("event_id", "calls", "bad")


@query("M2", LOG + "select strftime(date_trunc('hour', ts), '%Y-%m-%d %H') as start, tool, outcome, count(*) as n from query_log group by 1, 2, 3")
def usage_hourly(spark, sf):
    return usage.windowed(log(spark, sf), "1 hour").withColumn("start", F.date_format("start", "yyyy-MM-dd HH"))


@query("M4", LOG + """
, s as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minute then 0 else 1 end as new from query_log)
, g as (select user_id, ts, sum(new) over (partition by user_id order by ts rows unbounded preceding) as part from s)
select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as start, count(*) as n from g group by user_id, part""")
def usage_sessions(spark, sf):
    return usage.sessions(log(spark, sf)).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


STATUS = "select c_custkey as k, c_custkey % 2 = 0 as wiki_ready, c_custkey % 3 = 0 as graph_ready, c_custkey % 5 <> 0 as git_ready, case when c_custkey % 11 = 0 then 'down' end as ingest_error, c_custkey % 4 as pending, c_custkey * 100 as lag_seconds, c_custkey % 6 as community_count, c_custkey * 9000 as community_age, c_custkey % 3 as blocked, c_custkey % 2 as review, c_custkey as inbox, 0 as deferred, false as degraded, c_custkey as pages_indexed, case when c_custkey % 7 > 0 then c_custkey end as index_age, 1 as partial from customer"


def statuses(spark, sf):
    return spark.sql(STATUS.replace("from customer", "from {customer}"), customer=table(spark, sf, "customer"))


@query("T9 D13", f"""with s as ({STATUS}), r as (
select 'fail' as severity, 'wiki_ready' as rule from s where not wiki_ready union all select 'fail', 'graph_ready' from s where not graph_ready union all select 'fail', 'git_ready' from s where not git_ready
union all select 'fail', 'ingest_error' from s where ingest_error <> '' union all select 'fail', 'ingest_lag' from s where pending > 0 and lag_seconds > 7200 union all select 'fail', 'no_communities' from s where community_count = 0
union all select 'fail', 'communities_stale' from s where community_count <> 0 and community_age > 691200 union all select 'warn', 'blocked' from s where blocked > 0 union all select 'warn', 'review' from s where review > 0)
select severity, rule, count(*) as n from r group by 1, 2""")
def status_alerts(spark, sf):
    return status.alerts(statuses(spark, sf), unknown=True).groupBy("severity", "rule").agg(F.count("*").alias("n"))


GAUGES = f"""with s as ({STATUS}), v as (select k, unnest([
{{'name': 'wiki_index_ready', 'value': cast(wiki_ready as int)::double}}, {{'name': 'wiki_index_degraded', 'value': cast(degraded as int)::double}}, {{'name': 'wiki_pages_indexed', 'value': pages_indexed::double}},
{{'name': 'wiki_index_age_seconds', 'value': coalesce(index_age::double, case when not wiki_ready then 'inf'::double else 0 end)}}, {{'name': 'graph_ready', 'value': cast(graph_ready as int)::double}},
{{'name': 'inbox_notes', 'value': inbox::double}}, {{'name': 'deferred_notes', 'value': deferred::double}}, {{'name': 'blocked_notes', 'value': blocked::double}}, {{'name': 'review_queue_open', 'value': review::double}},
{{'name': 'ingest_pending_notes', 'value': pending::double}}, {{'name': 'ingest_partial_notes', 'value': partial::double}}, {{'name': 'ingest_lag_seconds', 'value': lag_seconds::double}},
{{'name': 'community_age_seconds', 'value': coalesce(community_age::double, case when graph_ready and community_count = 0 then 'inf'::double else 0 end)}}]) as x from s) """


@query("R8", GAUGES + "select x.name as name, x.value as value from v")
def status_gauges(spark, sf):
    """All gauges of every status."""
    return status.gauges(statuses(spark, sf), unknown=True)


COUNTED = f"select case when tool in {TOOLS} then tool else 'other' end as tool, {{outcome}} as outcome, count(*) as n from query_log group by 1, 2"


@query("S19", LOG + f", c as ({COUNTED.format(outcome='(case when ' + FAILED + " then 'error' when confidence = 'not_found' then 'not_found' when outcome = 'degraded' then 'degraded' else 'ok' end)")}), " + GAUGES.removeprefix("with ") + """
, m as (select concat('memory_', x.name) as name, 'gauge' as kind, concat('memory_', x.name, ' ', case when isinf(x.value) then '+Inf' else cast(x.value as varchar) end) as line from v where k = 3
  union all select 'memory_tool_calls_total', 'counter', concat('memory_tool_calls_total{outcome="', outcome, '",tool="', tool, '"} ', cast(n::double as varchar)) from c)
, b as (select name, concat('# TYPE ', name, ' ', any_value(kind), chr(10), string_agg(line, chr(10) order by line)) as block from m group by name)
select string_agg(block, chr(10) order by name) as text from b""")
def status_exposition(spark, sf):
    """One status and the use counters as an exposition text."""
    none = F.create_map().cast("map<string,string>")
    g = status.gauges(statuses(spark, sf).where("k = 3")).select(F.concat(F.lit("memory_"), "name").alias("name"), F.lit("gauge").alias("kind"), none.alias("labels"), "value")
    c = usage.counters(log(spark, sf)).where("n > 0").select(F.lit("memory_tool_calls_total").alias("name"), F.lit("counter").alias("kind"), F.create_map(F.lit("tool"), "tool", F.lit("outcome"), "outcome").alias("labels"), F.col("n").cast("double").alias("value"))
    return status.exposition(g.unionByName(c))


SAMPLES = """select {time} as "at", case when event_id % 3000 < 900 then 0 else 1 end as up, case when event_id % 2500 < 800 then 0 else 1 end as index_ready, case when event_id % 2000 < 900 then 1 else 0 end as index_degraded, event_id % 1500 as index_age, case when event_id % 4000 < 900 then 0 else 1 end as graph_ready,
  event_id % 5 as pending, event_id % 9000 as lag, case when event_id % 9000 < 8000 then 1 else 0 end as blocked, event_id % 120 as inbox, 40 as deferred, 30 as review, 20 + event_id % 9 as calls_10m, case when event_id % 1000 < 600 then 4 else 0 end as bad_10m,
  case when event_id % 700 < 300 then 1 else 0 end as drop_failures_10m, case when event_id % 6000 < 3000 then 700000 else 100 end as community_age from events"""
HOLDS = ", ".join(f"('{r}', {h}, '{s}')" for r, _, h, s in status.SERIES_RULES)


@query("T10 M3", f"""with s as ({SAMPLES.format(time='epoch(ts)')}), r as ({" union all ".join(f'select "at" as t, {chr(39)}{r}{chr(39)} as rule, coalesce({c}, false) as on_ from s' for r, c, _, _ in status.SERIES_RULES)})
, h as (select r.*, v.hold, v.severity, max(case when not on_ then t end) over w as off, min(t) over w as first from r join (values {HOLDS}) v(rule, hold, severity) on v.rule = r.rule window w as (partition by r.rule order by t rows between unbounded preceding and current row))
select cast(floor(t) as bigint) as "at", rule, severity from h where on_ and t - coalesce(off, first - 1) > hold""")
def status_series_alerts(spark, sf):
    """The eleven rules over samples of all that they read."""
    e = table(spark, sf, "events").withColumn("micros", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    samples = spark.sql(SAMPLES.format(time="micros").replace('"at"', "at").replace("from events", "from {events}"), events=e)
    return status.series_alerts(samples).withColumn("at", F.floor("at"))


HEALTH_NOW = "2001-08-02 06:00:00"


@query("T8a T8b T8c T8d T8e J11", cte("queue") + f""", a as (select queue, slug, ts, epoch(timestamp '{HEALTH_NOW}' - ts) / 3600.0 as hours from queue where ts is not null)
, due as (select slug from a where hours between 2 and 48 order by ts desc, slug limit 25), done as (select concat('note-', o_orderkey) as slug from orders where o_orderkey % 3 > 0)
, newest as (select arg_max(slug, (ts, slug)) as slug from a where queue = 'curated' and hours >= 6)
, w as (select coalesce(min(hours) <= 48, false) as write_path, count(*) filter (queue = 'inbox' and hours > 24) = 0 as inbox_age, not (count(*) filter (queue in ('inbox', 'deferred') and hours <= 72) > 0 and true) as stalled,
  count(*) filter (queue in ('inbox', 'deferred') and hours > 168) = 0 as pending_age, count(*) filter (queue = 'deferred') <= 200 as deferred_count from a)
select x.* from w, (select count(*) = 0 as ingestion from due where slug not in (select slug from done)) i, (select slug is null or slug in (select concat('note-', o_orderkey) from orders where o_orderkey % 2 = 0) as indexing from newest) n,
lateral (select unnest([{{'check': 'A', 'rule': 'write_path', 'severity': 'fail', 'ok': write_path}}, {{'check': 'B', 'rule': 'ingestion', 'severity': 'fail', 'ok': ingestion}}, {{'check': 'C', 'rule': 'inbox_age', 'severity': 'fail', 'ok': inbox_age}},
  {{'check': 'C', 'rule': 'stalled', 'severity': 'fail', 'ok': stalled}}, {{'check': 'C', 'rule': 'pending_age', 'severity': 'fail', 'ok': pending_age}}, {{'check': 'C', 'rule': 'deferred_count', 'severity': 'warn', 'ok': deferred_count}},
  {{'check': 'D', 'rule': 'search', 'severity': 'fail', 'ok': true}}, {{'check': 'D', 'rule': 'answer', 'severity': 'fail', 'ok': true}}, {{'check': 'D', 'rule': 'nonsense', 'severity': 'fail', 'ok': false}}, {{'check': 'D', 'rule': 'pages', 'severity': 'fail', 'ok': true}},
  {{'check': 'E', 'rule': 'indexing', 'severity': 'fail', 'ok': indexing}}], recursive := true)) x""")
def status_health(spark, sf):
    """All health checks over the queues; the probe's nonsense question was not escalated, and curation stands still."""
    notes = view(spark, sf, "queue").withColumn("ts", F.col("ts").cast("timestamp"))
    names = table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("note-"), "o_orderkey").alias("slug"))
    episodes = names.where("o_orderkey % 3 > 0").select("slug", (F.col("o_orderkey") % 3 == 1).alias("complete"), (F.col("o_orderkey") % 3 - 1).alias("mention_count"))
    probes = spark.range(1).select(F.lit(3).alias("facts"), F.lit(0).alias("entities"), F.lit("medium").alias("confidence"), F.lit("a").alias("answer"), F.lit("not_found").alias("none_confidence"), F.lit(None).cast("string").alias("none_answer"), F.lit(False).alias("none_escalate"), F.lit(3).alias("results"))
    now = F.lit(HEALTH_NOW).cast("timestamp")
    return status.health(notes, episodes, names.where("o_orderkey % 2 = 0").select(F.col("slug").alias("name")), probes, now, now - F.expr("interval 4 days"))


@query("A6", "select count(*) as count, strftime(max(o_orderdate), '%Y-%m-%d') as newest, cast(epoch(timestamp '2001-08-02 06:00:00') - epoch(max(o_orderdate)) as bigint) as age_seconds from orders")
def status_communities(spark, sf):
    nodes = table(spark, sf, "orders").select(F.col("o_orderdate").cast("timestamp").alias("created_at"))
    return status.communities(nodes, F.lit(HEALTH_NOW).cast("timestamp")).select("count", F.date_format("newest", "yyyy-MM-dd").alias("newest"), F.col("age_seconds").cast("long").alias("age_seconds"))


@query("R7", cte("queue", "query_log") + f""", q as (select queue, count(*) as n, cast(greatest(0, epoch(timestamp '{HEALTH_NOW}') - epoch(min(ts))) as bigint) as age from queue group by 1)
select false as ok, 'git=false,graph=true,wiki=true' as components, (select string_agg(concat(queue, '=', n, '/', age), ',' order by queue) from q) as queues, (select count(*) from documents) as pages_indexed,
(select count(*) from nation) as communities, count(*) as calls, count(*) filter (cached) as cache_hits from query_log where not test""")
def status_snapshot(spark, sf):
    """The whole status as one nested row; here its sections as text and numbers."""
    now = F.lit(HEALTH_NOW).cast("timestamp")
    parts = spark.createDataFrame([("wiki", True), ("graph", True), ("git", False)], "component string, ready boolean")
    queues = status.queue_summary(view(spark, sf, "queue").withColumn("ts", F.col("ts").cast("timestamp")), now)
    index = table(spark, sf, "documents").agg(F.count("*").alias("pages_indexed"))
    ingest = spark.range(1).select(F.lit(0).alias("pending"))
    groups = table(spark, sf, "nation").select(F.lit("2001-08-01").cast("timestamp").alias("created_at"))
    used = usage.real(log(spark, sf)).agg(F.count("*").alias("total"), F.count_if("cached").alias("cache_hits"))
    s = status.snapshot(parts, index, queues, ingest, status.communities(groups, now), used)
    shown = lambda c, f: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(e.key, F.lit("="), f(e.value))), ",")
    return s.select(
        "ok", shown("components", lambda v: v.cast("string")).alias("components"), shown("queues", lambda v: F.concat(v["count"].cast("string"), F.lit("/"), v["oldest_age_seconds"].cast("long").cast("string"))).alias("queues"),
        F.col("index.pages_indexed").alias("pages_indexed"), F.col("communities.count").alias("communities"), F.col("usage_24h.total").alias("calls"), F.col("usage_24h.cache_hits").alias("cache_hits"),
    )


@query("T11", "select c_custkey as k, c_custkey % 3 > 0 as ready, c_custkey % 3 > 0 and (c_custkey % 5 = 0 or c_custkey % 7 = 0) as degraded, case when c_custkey % 3 > 0 and (c_custkey % 5 = 0 or c_custkey % 7 = 0) then 'degraded' when c_custkey % 3 > 0 then 'ready' when c_custkey % 5 = 0 then 'error' else 'initializing' end as state from customer")
def pages_readiness(spark, sf):
    k = F.col("k")
    state = table(spark, sf, "customer").select(F.col("c_custkey").alias("k")).select("k", (k % 3).alias("usable"), F.when(k % 7 == 0, 2).otherwise(0).alias("omitted"), F.when(k % 5 == 0, "broken").alias("error"))
    return pages.readiness(state).select("k", "ready", "degraded", "state")


@query("A27", "select event_type as job, 2000000 - max(event_id) as since_success, max(user_id) as active from events group by 1")
def status_scheduler(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("job"), F.col("event_id").alias("last_success"), F.col("user_id").alias("active"), *[F.lit(0).alias(c) for c in ("suspended", "failed", "succeeded")])
    return status.scheduler(e, F.lit(2_000_000)).select("job", "since_success", "active")


FIELD = "nullif(regexp_replace(trim(regexp_extract(block, '(?m)^{}:[ \\t]*(.*)$', 1)), '^([''\"])(.*)[''\"]$', '\\2'), '')"
FRONT = "(?s)^---\\n(.*?)\\n---\\n?"
PAGES = cte("pages") + f", blocks as (select *, case when regexp_matches(content, '{FRONT}') then regexp_extract(content, '{FRONT}', 1) end as block, regexp_replace(content, '{FRONT}', '') as body from pages), cat as (select name, path, block, body, content, {FIELD.format('type')} as type, {FIELD.format('category')} as category, {FIELD.format('status')} as status, {FIELD.format('created')} as created from blocks) "
INSIDE = "list_distinct(list_filter(list_transform(regexp_extract_all(regexp_replace({}, '`[^`\\n]+`', '', 'g'), '\\[\\[([^\\]\\n]+?)\\]\\]', 1), lambda x: trim(split_part(split_part(x, '|', 1), '#', 1))), lambda x: x <> ''))"
LINKS = PAGES + f""", found as (select name as src, unnest({INSIDE.format('body')}) as dst from cat) """


def catalog(spark, sf):
    return pages.catalog(view(spark, sf, "pages"))


@query("S2 P1 D2 S3 S4", PAGES + "select name, type, category, status from cat")
def pages_catalog(spark, sf):
    return catalog(spark, sf).select("name", "type", "category", "status")


@query("J3 P2 D3", LINKS + "select src, dst from found where dst in (select name from cat)")
def pages_links(spark, sf):
    return pages.links(catalog(spark, sf))


@query("X5", LINKS + "select 'doc-21' as name, coalesce(list_sort(list(distinct src)), []) as backlinks from found where dst = 'doc-21'")
def pages_backlinks(spark, sf):
    return pages.backlinks(catalog(spark, sf), "doc-21")


@query("J4 Q10", LINKS + "select src, dst as target, case when n.low is null then 'broken' else 'case' end as problem, n.expected from found left join (select lower(name) as low, max(name) as expected from cat group by 1) n on n.low = lower(dst) where n.low is null or n.expected <> dst")
def pages_link_problems(spark, sf):
    return pages.link_problems(catalog(spark, sf))


@query("T6 U3 U4 D4", """with p as (select name, h, left(h, 16) as legacy from (select concat('doc-', doc_id) as name, sha256(text) as h from documents where doc_id % 10 <> 9)), c as (select concat('doc-', doc_id) as name, case when doc_id % 4 = 0 then 'x' when doc_id % 4 = 1 then left(sha256(text), 16) else sha256(text) end as hash, case when doc_id % 4 = 1 then 'legacy-body-v0' else 'embedding-input-v1' end as f from documents where doc_id % 10 <> 8)
select coalesce(p.name, c.name) as name, case when p.name is null then 'remove' when c.f = 'embedding-input-v1' and c.hash = p.h then 'reuse' when c.f = 'legacy-body-v0' and c.hash = p.legacy then 'migrate' else 'embed' end as action from p full join c on c.name = p.name""")
def pages_reindex(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("doc-"), "doc_id").alias("name"), F.sha2("text", 256).alias("h"))
    short = F.substring("h", 1, 16)
    p = d.where("doc_id % 10 <> 9").select("name", F.col("h").alias("hash"), short.alias("legacy_hash"))
    r = F.col("doc_id") % 4
    c = d.where("doc_id % 10 <> 8").select("name", F.when(r == 0, "x").when(r == 1, short).otherwise(F.col("h")).alias("hash"), F.when(r == 1, "legacy-body-v0").otherwise("embedding-input-v1").alias("hash_format"))
    return pages.reindex(p, c)


def issues(spark, sf):
    return lint.lint(catalog(spark, sf))


NOTE_PATH = "regexp_matches(path, '(^|/)sources/notes/')"
ISSUES = PAGES + f"""
, p as (select *, trim(regexp_extract(body, '(?m)^# (.+?)$', 1)) as h1, {FIELD.format('updated')} as updated, {FIELD.format('superseded-by')} as successor, {FIELD.format('length-exempt')} as exempt, regexp_extract(path, 'sources/notes/(.*)$', 1) as rest,
  length(content) - length(replace(content, chr(10), '')) as n, {NOTE_PATH} as note, string_split(regexp_extract(block, '(?m)^tags:[ \\t]*\\[(.*)\\][ \\t]*$', 1), ',') as tags, regexp_extract(block, '(?m)^sources:[ \\t]*(\\[.*\\])[ \\t]*$', 1) as listed from cat)
, e as (select *, list_transform(tags, lambda t: trim(t)) as tag from p)
, alone as (select path as file, unnest(list_concat([
    case when block is not null and h1 <> '' and h1 <> name and name not in ('index', 'log', 'MEMORY') and not (regexp_matches(path, '(^|/)log/') and regexp_matches(name, '^\\d{{4}}-(W\\d{{2}}|\\d{{2}})$')) then 'error/h1' end,
    case when block is null then 'error/frontmatter' end, case when block is not null and type is null then 'warning/type_missing' end, case when type not in ('entity', 'concept', 'source', 'synthesis', 'decision', 'log', 'index') then 'warning/type' end,
    case when (type = 'entity' and status not in ('live', 'degraded', 'dormant', 'retired', 'broken', 'candidate', 'not-installed', 'legacy')) or (type = 'decision' and status not in ('undecided', 'decided', 'superseded')) then 'warning/status' end,
    case when type in ('concept', 'synthesis', 'source', 'log', 'index') and status is not null then 'info/status_unused' end, case when not regexp_full_match(created, '\\d{{4}}-\\d{{2}}-\\d{{2}}') then 'warning/created' end,
    case when not regexp_full_match(updated, '\\d{{4}}-\\d{{2}}-\\d{{2}}') then 'warning/updated' end, case when regexp_matches(block, '(?m)^sources:[ \\t]*[^\\s\\[]') then 'warning/sources' end, case when type = 'decision' and status is null then 'warning/decision_status' end,
    case when type = 'decision' and status = 'superseded' and successor is null then 'warning/superseded_by' end, case when block is not null and note and not (regexp_full_match(rest, '\\d{{4}}/\\d{{2}}/\\d{{2}}/[^/]+/[^/]+') and starts_with(split_part(rest, '/', 4), concat(replace(left(rest, 10), '/', '-'), '-'))) then 'error/nesting' end,
    case when exempt is null and ((type = 'concept' and n > 150) or (type = 'entity' and n > 250)) then 'info/length' end],
    case when block is null then [] else list_concat(list_transform(list_filter(tag, lambda t: t <> lower(t)), lambda t: 'warning/tag_case'), list_transform(list_filter(tag, lambda t: contains(t, ' ')), lambda t: 'warning/tag_blank')) end)) as issue from e)
, pairs as (select name, path, unnest(list_distinct(list_concat({INSIDE.format('body')}, {INSIDE.format("coalesce(listed, '')")}))) as dst from e where block is not null and not note)
, linked as (select path as file, case when n.low is null then 'error/link' else 'warning/link_case' end as issue from pairs left join (select lower(name) as low, max(name) as expected from cat group by 1) n on n.low = lower(dst) where n.low is null or n.expected <> dst)
, issues as (select * from alone where issue is not null union all select * from linked) """


@query("Q1 Q2 Q3 Q4 Q5 Q6 Q7 Q8 Q9 Q10 Q11 D16 S5", ISSUES + "select file, split_part(issue, '/', 1) as severity, split_part(issue, '/', 2) as rule, count(*) as n from issues group by all")
def lint_rules(spark, sf):
    """How often each page breaks each rule."""
    return issues(spark, sf).groupBy("file", "severity", "rule").agg(F.count("*").alias("n"))


#: Frontmatter that parses and frontmatter that does not, lists and what only looks like one.
FRONTS = """select concat('wiki/doc-', doc_id, '.md') as path, concat('---', chr(10), 'type: concept', chr(10), case doc_id % 6 when 0 then 'tags: [a, b]' when 1 then 'tags: [open' when 2 then 'tags: one' when 3 then concat('tags: [1, ab, No]', chr(10), 'sources: [[[x]], "y"]') when 4 then concat('sources: one', chr(10), 'created: 20240101') else concat('a: b: c', chr(10), 'tags: Big') end,
  chr(10), '---', chr(10), '# doc-', doc_id, chr(10), chr(10), substr(text, 1, 100), chr(10)) as content from {documents}"""


@query("Q1 Q5 Q6 Q7 F7", """select concat('wiki/doc-', doc_id, '.md') as file, x.severity as severity, x.rule as rule, count(*) as n from documents, lateral (select unnest(case doc_id % 6 when 0 then [] when 1 then [{'severity': 'error', 'rule': 'frontmatter_parse'}] when 2 then [{'severity': 'warning', 'rule': 'tags'}]
  when 3 then [{'severity': 'warning', 'rule': 'tag_string'}, {'severity': 'warning', 'rule': 'tag_string'}, {'severity': 'warning', 'rule': 'source_string'}, {'severity': 'error', 'rule': 'link'}] when 4 then [{'severity': 'warning', 'rule': 'sources'}, {'severity': 'warning', 'rule': 'created'}] else [{'severity': 'error', 'rule': 'frontmatter_parse'}] end) as x) where text is not null group by 1, 2, 3""")
def lint_frontmatter(spark, sf):
    """The rules that need frontmatter parsed, by page."""
    pages_ = pages.catalog(spark.sql(FRONTS, documents=table(spark, sf, "documents").where("text is not null").withColumn("text", F.translate("text", "[]#", ""))))
    found = lint.lint(pages_).groupBy("file", "severity", "rule").agg(F.count("*").alias("n"))
    return found


@query("A12 Q12", ISSUES + "select count(*) filter (starts_with(issue, 'error')) as errors, count(*) filter (starts_with(issue, 'warning')) as warnings, count(*) filter (starts_with(issue, 'info')) as infos, 1 as exit_code from issues")
def lint_summary(spark, sf):
    return lint.summary(issues(spark, sf))


@query("X4", LINKS + "select 'doc-21' as name, (select type from cat where name = 'doc-21') as type, (select list_sort(list(dst)) from found where src = 'doc-21') as wikilinks_out, coalesce((select list_sort(list(distinct src)) from found where dst = 'doc-21'), []) as wikilinks_in")
def pages_get(spark, sf):
    return pages.page(catalog(spark, sf), "doc-21").select("name", "type", "wikilinks_out", "wikilinks_in")


@query("A13", PAGES + "select type, coalesce(category, 'Uncategorized') as category, count(*) as n from cat group by 1, 2")
def report_by_type(spark, sf):
    return report.by_type(catalog(spark, sf))


INDEX = PAGES + """
, raw as (select *, regexp_extract(regexp_replace(body, '^# [^\\n]+\\n', ''), '(?s)^\\s*(.*?)(?:\\n\\n|$)', 1) as para0 from cat)
, once as (select *, regexp_replace(para0, 'SHOWN', '\\1\\2\\3\\4', 'g') as para1 from raw), shown as (select *, trim(regexp_replace(regexp_replace(para1, 'SHOWN', '\\1\\2\\3\\4', 'g'), '\\s+', ' ', 'g')) as para from once)
, d as (select *, case when length(para) <= 220 then para when regexp_matches(left(para, 220), '(?s)^.{101,}\\. ') then regexp_extract(left(para, 220), '(?s)^(.{101,}\\.) ', 1) else concat(rtrim(left(para, 220)), '…') end as description from shown)
, line as (select *, concat('- [[', name, ']]', case when type = 'decision' then concat(' **[', coalesce(status, '?'), ']**') else '' end, case when trim(coalesce(description, '')) <> '' then concat(' — ', trim(description)) else '' end) as line from d)
, months as (select regexp_extract(coalesce(created, name), '^(\\d{4}-\\d{2})', 1) as month, count(*) as n from cat where type = 'source' group by 1)
, rows_ as (select 1 as section, case when coalesce(category, '') = '' then 10000 when category = 'cat2' then 1 when category = 'cat0' then 2 else 5000 end as slot, coalesce(category, 'Uncategorized') as category, lower(name) as key, line from line where type = 'entity'
  union all select case type when 'concept' then 2 when 'synthesis' then 3 else 4 end, 0, null, lower(name), line from line where type in ('concept', 'synthesis', 'decision')
  union all select 5, -row_number() over (order by m), null, '', concat('- **', m, '** — ', n, ' sources') from (select case when month = '' then 'undated' else month end as m, n from months))
select section, category, row_number() over (partition by section order by slot, coalesce(category, ''), key, line) as ord, line from rows_""".replace("SHOWN", T.SHOWN)


@query("R1 O11 P18 P29", INDEX)
def report_index(spark, sf):
    dated = catalog(spark, sf).withColumn("created", T.frontmatter_field(F.col("block"), "created"))
    return report.index_lines(dated, ("cat2", "cat0"))


CHANGES = "select event_id as seq, case event_type when 'click' then 'A' when 'error' then 'D' else 'M' end as status, concat('wiki/p', user_id, '.md') as path from events"


def changes(spark, sf):
    return spark.sql(CHANGES.replace("from events", "from {events}"), events=table(spark, sf, "events"))


@query("A15 S11 D18", f"with c as ({CHANGES}) select path, arg_min(status, seq) as first, arg_max(status, seq) as last from c group by 1")
def report_path_changes(spark, sf):
    return report.path_changes(changes(spark, sf))


@query("A14 R3", f"""with c as ({CHANGES}), p as (select path, arg_min(status, seq) as first, arg_max(status, seq) as last from c group by 1), t as (select concat('wiki/p', c_custkey, '.md') as path, c_mktsegment as type from customer where c_custkey % 3 <> 0)
, k as (select p.path, case when last = 'D' then 'deleted' when first = 'A' then 'added' else 'modified' end as kind, t.type from p left join t on t.path = p.path) select kind, case when kind <> 'deleted' then coalesce(type, '(unknown)') end as type, count(*) as n from k group by 1, 2""")
def report_distill(spark, sf):
    types = table(spark, sf, "customer").where("c_custkey % 3 <> 0").select(F.concat(F.lit("wiki/p"), "c_custkey", F.lit(".md")).alias("path"), F.col("c_mktsegment").alias("type"))
    return report.distill(changes(spark, sf), types)


ENTRIES = "select case when o_orderkey % 23 = 0 then '2001-99-99' else strftime(o_orderdate, '%Y-%m-%d') end as date, o_orderkey as seq from orders"


def entries(spark, sf):
    return table(spark, sf, "orders").select(F.when(F.col("o_orderkey") % 23 == 0, "2001-99-99").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("date"), F.col("o_orderkey").alias("seq"))


WEEK = "format('{:d}-W{:02d}', isoyear(d), week(d))"


@query("R4 O13 D17 S12", f"""with e as ({ENTRIES}), x as (select *, try_cast(date as date) as d from e), t as (select *, case when d is null then 'quarantine' when d >= date '2001-08-01' - 14 then 'live' else {WEEK} end as target from x)
select seq, target, row_number() over (partition by target order by date desc, seq) as ord from t""")
def report_rotate(spark, sf):
    return report.rotate(entries(spark, sf), F.lit("2001-08-01").cast("date")).select("seq", "target", "ord")


STORED = f"select format('{{:d}}-W{{:02d}}', isoyear(o_orderdate), week(o_orderdate)) as week, strftime(o_orderdate, '%Y-%m-%d') as date, -o_orderkey as seq from orders where o_orderkey % 5 = 0"


@query("R4", f"""with e as ({ENTRIES}), x as (select *, try_cast(date as date) as d from e where seq % 3 = 0), a as (select {WEEK} as week, date, seq, true as moved from x where d < date '2001-08-01' - 14)
, m as (select * from a union all select week, date, seq, false from ({STORED}) where week in (select week from a)) select week, seq, moved, row_number() over (partition by week order by date desc, moved desc, seq) as ord from m""")
def report_archives(spark, sf):
    """A third of the entries rotated into archives that hold a fifth of them already."""
    o, text = table(spark, sf, "orders"), F.lit("x").alias("text")
    day = F.col("o_orderdate").cast("date")
    stored = o.where("o_orderkey % 5 = 0").select(report.week(day).alias("week"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), (-F.col("o_orderkey")).alias("seq"), text)
    return report.archives(entries(spark, sf).where("seq % 3 = 0").select("*", text), stored, F.lit("2001-08-01").cast("date")).select("week", "seq", "moved", "ord")


@query("R3 A14", f"""with d as (select max(ts::date) as day from events where event_id % 700 = 5), c as (select event_id as seq, case event_type when 'click' then 'A' when 'error' then 'D' else 'M' end as status, concat('wiki/p', user_id, '.md') as path from events, d where ts::date >= d.day)
, p as (select path, arg_min(status, seq) as first, arg_max(status, seq) as last from c group by 1), t as (select concat('wiki/p', c_custkey, '.md') as path, c_mktsegment as type from customer where c_custkey % 3 <> 0)
, k as (select p.path, case when last = 'D' then 'deleted' when first = 'A' then 'added' else 'modified' end as kind, t.type from p left join t on t.path = p.path) select kind, case when kind <> 'deleted' then coalesce(type, '(unknown)') end as type, count(*) as n from k group by 1, 2""")
def report_distill_since(spark, sf):
    """What changed since the last distill, whose day its page's name has."""
    e = table(spark, sf, "events")
    log_ = changes(spark, sf).join(e.select(F.col("event_id").alias("seq"), F.col("ts").alias("at")), "seq")
    written = e.where("event_id % 700 = 5").select(F.concat(F.lit("distill-"), F.date_format("ts", "yyyy-MM-dd")).alias("name"))
    types = table(spark, sf, "customer").where("c_custkey % 3 <> 0").select(F.concat(F.lit("wiki/p"), "c_custkey", F.lit(".md")).alias("path"), F.col("c_mktsegment").alias("type"))
    return report.distill(report.since_last(log_, written), types)


@query("A16", f"with e as ({ENTRIES}), x as (select try_cast(date as date) as d from e) select {WEEK} as week, count(*) as n from x where d is not null group by 1")
def report_per_week(spark, sf):
    return report.per_week(entries(spark, sf))
