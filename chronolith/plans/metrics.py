"""Queries over cumulative counters that the events make: they begin again after every four thousand events."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronolith.operators import counters

from .registry import query
from .workload import table

X = "(event_id % 4000)"
#: One sample of each series at every event. {time}: seconds; {inf}: infinity.
ANSWERS = f"""select c.confidence, c.grounded, {{time}} as "at", floor({X} * c.weight) as value from events cross join (select 'high' as confidence, 'true' as grounded, 3.5 as weight union all select 'high', 'false', 0.2 union all select 'error', 'true', 0.1) c"""
DROPS = f"""select c.outcome, {{time}} as "at", floor({X} * c.weight) as value from events cross join (select 'success' as outcome, 0.7 as weight union all select 'conflict', 0.001) c"""
BUCKETS = f"""select c.tool, c.le, {{time}} as "at", floor({X} * c.share + (case when {X} > 2000 then {X} - 2000 else 0 end) * (1 - c.share) / 2) as value
from events cross join (select t.tool, b.le, b.share from (select 'wiki_search' as tool union all select 'graph_answer') t cross join (select 0.05 as le, 0.1 as share union all select 0.25, 0.4 union all select 1.0, 0.8 union all select 5.0, 0.99 union all select {{inf}}, 1.0) b) c
where c.tool = 'graph_answer' or event_id % 3 <> 1"""
GAUGES = """select event_id % 2 as instance, {time} as "at", case when event_id % 3000 < 900 then 0 else 1 end as up, case when event_id % 2500 < 800 then 0 else 1 end as index_ready, case when event_id % 2000 < 900 then 1 else 0 end as index_degraded, event_id % 1500 as index_age, case when event_id % 4000 < 900 then 0 else 1 end as graph_ready,
  event_id % 5 as pending, event_id % 9000 as lag, case when event_id % 9000 < 8000 then 1 else 0 end as blocked, event_id % 120 as inbox, 40 as deferred, 30 as review, case when event_id % 6000 < 3000 then 700000 else 100 end as community_age from events"""


def made(spark, sf, sql):
    e = table(spark, sf, "events").withColumn("micros", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return spark.sql(sql.format(time="micros", inf="double('infinity')").replace('"at"', "at").replace("from events", "from {events}"), events=e)


def rates_sql(source: str, keys: str, window: int, step: int) -> str:
    """Counter windows in SQL: every sample with every window's end, then the extension to the edges."""
    samples = source.format(time="epoch(ts)", inf="'inf'::double")
    return f"""s as (select {keys}, "at" as a, cast(value as double) as v, lag("at") over w as pa, lag(cast(value as double)) over w as pv from ({samples}) window w as (partition by {keys} order by "at", value))
, e as (select *, {step} * unnest(range(cast(ceil(a / {step}) as bigint), cast(ceil((a + {window}) / {step}) as bigint))) as t from s)
, g as (select {keys}, t, count(*) as n, min(a) as fa, max(a) as la, arg_min(v, (a, v)) as fv, arg_max(v, (a, v)) as lv, sum(case when v < pv and pa > t - {window} then pv else 0 end) as undone from e group by {keys}, t)
, h as (select *, la - fa as span, lv - fv + undone as rise, (la - fa) / (n - 1) as mean from g where n > 1 and la > fa)
, x as (select *, case when fa - (t - {window}) < 1.1 * mean then fa - (t - {window}) else mean / 2 end as gs, case when t - la < 1.1 * mean then t - la else mean / 2 end as ge, case when rise > 0 and fv >= 0 then span * fv / rise end as z from h)
, r as (select {keys}, t as "at", n, rise * (span + least(gs, z) + ge) / span as increase from x)"""


@query("M3", f"with {rates_sql(ANSWERS, 'confidence, grounded', 600, 300)} select confidence, grounded, \"at\", n, increase, increase / 600 as rate from r")
def usage_counter_rates(spark, sf):
    """Increases and rates of counters with resets over 10 minutes, every 5 minutes."""
    return counters.increases(made(spark, sf, ANSWERS), ["confidence", "grounded"], 600, 300)


@query("M3", f"with {rates_sql(DROPS, 'outcome', 300, 60)} select outcome, \"at\", n, increase, increase / 300 as rate from r")
def usage_drop_rates(spark, sf):
    return counters.increases(made(spark, sf, DROPS), ["outcome"], 300, 60)


@query("A18 M3", f"""with {rates_sql(BUCKETS, 'tool, le', 900, 300)}
, b as (select tool, "at", le, max(increase / 900) over (partition by tool, "at" order by le) as c from r), t as (select tool, "at", max(c) as total, count(*) as k, max(le) as top, max(le) filter (le < 1e300) as bound from b group by 1, 2)
, l as (select b.*, coalesce(lag(le) over w, 0) as start, coalesce(lag(c) over w, 0) as under from b window w as (partition by tool, "at" order by le))
, hit as (select l.tool, l."at", l.le, l.c, l.start, l.under, row_number() over (partition by l.tool, l."at" order by l.le) as first, t.total from l join t on l.tool = t.tool and l."at" = t."at" where l.c >= 0.95 * t.total and l.le < 1e300)
select t.tool, t."at", case when t.k < 2 or t.top < 1e300 or t.total = 0 then 'nan'::double when hit.le is null then t.bound else hit.start + (hit.le - hit.start) * (0.95 * t.total - hit.under) / (hit.c - hit.under) end as value
from t left join hit on hit.tool = t.tool and hit."at" = t."at" and hit.first = 1""")
def usage_latency_quantiles(spark, sf):
    """The 95th percentile of durations by tool, from the rates of cumulative buckets."""
    rates = counters.increases(made(spark, sf, BUCKETS), ["tool", "le"], 900, 300)
    return counters.histogram_quantile(rates.select("tool", "at", F.col("le").cast("double").alias("le"), F.col("rate").alias("n")), ["tool", "at"], 0.95)


SHOWN = ("up", "index_ready", "index_degraded", "index_age", "graph_ready", "pending", "lag", "blocked", "inbox", "deferred", "review", "community_age")
RULES = (
    ("server_down", "coalesce(up, 0) = 0", 300, "critical"), ("index_unready", "index_ready = 0", 600, "critical"), ("index_degraded", "index_degraded = 1", 900, "warning"), ("index_stale", "index_age > 900", 600, "warning"),
    ("graph_not_ready", "graph_ready = 0", 600, "critical"), ("ingest_lag", "pending > 0 and lag > 7200", 900, "critical"), ("blocked_sustained", "blocked > 0", 86400, "warning"), ("curator_backlog", "inbox + deferred + review > 100", 21600, "warning"),
    ("answer_quality", "calls >= 20 and bad / 600 / greatest(calls / 600, 0.001) > 0.05", 600, "warning"), ("note_drop_failures", "failures > 0", 300, "critical"), ("communities_stale", "community_age > 691200", 1800, "warning"),
)


@query("T10 M3", f"""with ca as (with {rates_sql(ANSWERS, 'confidence, grounded', 600, 300)} select "at" as t, sum(increase) as calls, sum(case when confidence = 'error' or grounded = 'false' then increase else 0 end) as bad from r group by 1)
, cd as (with {rates_sql(DROPS, 'outcome', 600, 300)} select "at" as t, sum(increase) as failures from r where outcome not in ('success', 'ok', 'already_exists') group by 1)
, gs as ({GAUGES.format(time='epoch(ts)')}), ge as (select *, 300 * unnest(range(cast(ceil("at" / 300) as bigint), cast(ceil(("at" + 300) / 300) as bigint))) as t from gs)
, gl as (select instance, t, {', '.join(f'arg_max({c}, "at") as {c}' for c in SHOWN)} from ge group by 1, 2), g as (select t, {', '.join(f'max({c}) as {c}' for c in SHOWN)} from gl group by 1)
, ts as (select t from g union select t from ca union select t from cd), grid as (select unnest(range((select min(t) from ts), (select max(t) from ts) + 1, 300)) as t)
, s as (select grid.t, {', '.join(SHOWN)}, calls, bad, failures from grid left join g on g.t = grid.t left join ca on ca.t = grid.t left join cd on cd.t = grid.t)
, on_ as ({' union all '.join(f"select t, '{r}' as rule, {h} as hold, '{v}' as severity, coalesce({c}, false) as lit from s" for r, c, h, v in RULES)})
, k as (select *, max(case when not lit then t end) over w as off, min(t) over w as first from on_ window w as (partition by rule order by t rows between unbounded preceding and current row))
select t as "at", rule, severity from k where lit and t - coalesce(off, first - 1) > hold""")
def status_counter_alerts(spark, sf):
    """The eleven rules from gauges of two instances and from counters with resets, every 5 minutes."""
    return counters.counter_alerts(made(spark, sf, GAUGES), ["instance"], made(spark, sf, ANSWERS), made(spark, sf, DROPS), step=300)
