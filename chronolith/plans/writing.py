"""Queries over what writes to the knowledge base: ingestion, queues, ingest logs and agent runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronolith.functions import text as T
from chronolith.operators import ingest, queues, status
from chronolith.sources import files

from .registry import query
from .workload import cte, table, view

NOW = "2001-09-01"
TS = "strptime(substr({}, 1, 17), '%Y-%m-%d-%H%M%S')"

ASSESSED = cte("notes", "episodes") + """
, d as (select * from (select *, row_number() over (partition by slug order by created_at desc, uuid desc) as rn from episodes where complete) where rn = 1)
, m as (select * from (select *, row_number() over (partition by slug order by created_at desc, uuid desc) as rn from episodes where complete is not true and mention_count > 0) where rn = 1)
, a as (select distinct slug from episodes)
, assessed as (select n.slug, case when a.slug is null then 'missing' when d.uuid is not null and (d.content_hash is null or d.content_hash = sha256(n.body)) then 'done' when d.uuid is not null then 'changed' when m.uuid is not null then 'done' else 'partial' end as disposition,
  case when d.uuid is not null then case when d.content_hash is null and d.content = n.body then d.uuid end when m.content_hash is null and m.content = n.body then m.uuid end as upgrade_uuid
  from notes n left join a on a.slug = n.slug left join d on d.slug = n.slug left join m on m.slug = n.slug) """


def assessed(spark, sf):
    notes = view(spark, sf, "notes").withColumn("ts", T.slug_timestamp(F.col("slug")))
    return ingest.assess(notes, view(spark, sf, "episodes"))


@query("T1 J10 W4 A23 D1 D5 D20 P3 P6", ASSESSED + "select slug, disposition, upgrade_uuid from assessed")
def ingest_assess(spark, sf):
    """What each note needs: nothing, a retry, a new reading or a first one."""
    return assessed(spark, sf).select("slug", "disposition", "upgrade_uuid")


@query("A4 A5 U1", ASSESSED + """select count(*) as notes, count(*) filter (disposition = 'done') as done, count(*) filter (disposition = 'partial') as partial, count(*) filter (disposition = 'changed') as changed,
count(*) filter (disposition = 'missing') as missing, count(*) filter (disposition <> 'done') as pending, (select count(*) from episodes) as episodes, (select count(*) from episodes where complete) as completed, (select coalesce(max(completed_at), 'none') from episodes) as watermark from assessed""")
def ingest_rollup(spark, sf):
    return ingest.rollup(assessed(spark, sf), view(spark, sf, "episodes"))


@query("W2 O8 T4", ASSESSED + f"select slug, disposition from assessed where disposition <> 'done' order by {TS.format('slug')}, slug limit 15")
def ingest_batch(spark, sf):
    """The next batch: the oldest 15 pending notes."""
    return ingest.oldest(ingest.pending(assessed(spark, sf)), ingest.BATCH).select("slug", "disposition")


@query("T2 S16", ASSESSED + f"""
, chosen as (select * from assessed where upgrade_uuid is not null order by {TS.format('slug')}, slug limit 25)
select e.uuid, case when c.slug is not null then true else e.complete end as complete, case when c.slug is not null then sha256(n.body) else e.content_hash end as content_hash, case when c.slug is not null then coalesce(e.completed_at, '2024-06-01') else e.completed_at end as completed_at
from episodes e left join chosen c on c.upgrade_uuid = e.uuid left join notes n on n.slug = c.slug""")
def ingest_upgrade(spark, sf):
    done = ingest.upgrade_episodes(view(spark, sf, "episodes"), ingest.upgrades(assessed(spark, sf)).select("slug", "upgrade_uuid"), view(spark, sf, "notes"), F.lit("2024-06-01"))
    return done.select("uuid", "complete", "content_hash", "completed_at")


@query("S17 T3 G7", cte("episodes", "notes") + "select count(*) as episodes, count(distinct slug) as slugs from episodes where slug not in (select slug from notes where doc_id % 3 = 0)")
def ingest_remove_episodes(spark, sf):
    """Episodes of every third note go, with their mentions and the facts that only they carried."""
    e = view(spark, sf, "episodes")
    mentions = e.select(F.col("uuid").alias("episode_uuid"), F.lit("x").alias("entity_uuid"))
    facts = e.select(F.concat(F.lit("f"), "uuid").alias("uuid"), F.array("uuid").alias("episodes"))
    kept, _, _ = ingest.remove_episodes(e, mentions, facts, view(spark, sf, "notes").where("doc_id % 3 = 0"))
    return kept.agg(F.count("*").alias("episodes"), F.countDistinct("slug").alias("slugs"))


@query("G7 S17", cte("episodes", "notes") + """, gone as (select uuid from episodes where slug in (select slug from notes where doc_id % 3 = 0)), mentions as (select uuid as episode, concat('m', uuid) as uuid from episodes)
, facts as (select concat('f', doc_id) as uuid, concat('e', doc_id, '-1') as a, concat('e', doc_id + 1 + doc_id % 2, '-2') as b from documents)
select 'episode' as kind, uuid from episodes where uuid not in (select uuid from gone) union all select 'mention', uuid from mentions where episode not in (select uuid from gone)
union all select 'fact', uuid from facts where not (a in (select uuid from gone) and b in (select uuid from gone))""")
def ingest_removal_cascade(spark, sf):
    """What is left of all three when every third note's episodes go: facts that another episode carries stay."""
    e = view(spark, sf, "episodes")
    mentions = e.select(F.col("uuid").alias("episode_uuid"), F.concat(F.lit("m"), "uuid").alias("entity_uuid"))
    d = F.col("doc_id")
    facts = table(spark, sf, "documents").select(F.concat(F.lit("f"), d).alias("uuid"), F.array(F.concat(F.lit("e"), d, F.lit("-1")), F.concat(F.lit("e"), d + 1 + d % 2, F.lit("-2"))).alias("episodes"))
    parts = ingest.remove_episodes(e, mentions, facts, view(spark, sf, "notes").where("doc_id % 3 = 0"))
    names = (("episode", "uuid"), ("mention", "entity_uuid"), ("fact", "uuid"))
    rows = [part.select(F.lit(kind).alias("kind"), F.col(c).alias("uuid")) for part, (kind, c) in zip(parts, names)]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


BARE = "select case doc_id % 4 when 0 then concat('note-', doc_id, '.md') when 1 then concat('note-', doc_id, '/note-', doc_id, '.md') when 2 then concat('note-', doc_id, '/NOTE.md') else concat('note-', doc_id - 3, '/note-', doc_id - 3, '.md') end as path, doc_id from documents union all select 'README.md', -1"


@query("B1", f"with f as ({BARE}), w as (select case when regexp_matches(path, '^[^/]+[.]md$') and path <> 'README.md' then concat(left(path, -3), '/', path) else path end as to_, regexp_matches(path, '^[^/]+[.]md$') and path <> 'README.md' as moved, doc_id from f) select to_ as path, moved, doc_id from (select *, row_number() over (partition by to_ order by moved desc) as n from w) where n = 1")
def queue_wrapped(spark, sf):
    """Bare notes in folders of their own; some take an older file's place."""
    return queues.wrapped(spark.sql(BARE.replace("from documents", "from {documents}"), documents=table(spark, sf, "documents"))).select("path", "moved", "doc_id")


@query("J1", cte("episodes") + "select e.uuid, coalesce(m.n, 0) as mention_count from episodes e left join (select concat('e', l_orderkey, '-1') as uuid, count(*) as n from lineitem group by 1) m on m.uuid = e.uuid")
def ingest_mention_counts(spark, sf):
    mentions = table(spark, sf, "lineitem").select(F.concat(F.lit("e"), "l_orderkey", F.lit("-1")).alias("episode_uuid"))
    return ingest.with_mentions(view(spark, sf, "episodes").drop("mention_count"), mentions).select("uuid", "mention_count")


@query("W8 T4", """with i as (select o_custkey, o_orderkey as seq, o_orderstatus <> 'F' as ok, sum(case when o_orderstatus <> 'F' then 1 else 0 end) over (partition by o_custkey order by o_orderkey) as island from orders)
, s as (select *, case when ok then 0 else sum(case when ok then 0 else 1 end) over (partition by o_custkey, island order by seq) end as streak from i)
select o_custkey, seq, cast(streak as bigint) as streak, coalesce(max(case when streak >= 3 then 1 else 0 end) over (partition by o_custkey order by seq rows between unbounded preceding and 1 preceding), 0) = 1 as stopped from s""")
def ingest_breaker(spark, sf):
    runs = table(spark, sf, "orders").select("o_custkey", F.col("o_orderkey").alias("seq"), (F.col("o_orderstatus") != "F").alias("ok"))
    return ingest.breaker(runs, "o_custkey").select("o_custkey", "seq", F.col("streak").cast("long").alias("streak"), "stopped")


@query("J12 M8", "select concat('n', o_orderkey) as slug, min_by(folder, ord) as folder from orders join (select c_custkey as k, concat('2024-', c_custkey, '-n', c_custkey) as folder, c_custkey as ord from customer) on k = o_custkey and ends_with(folder, concat('-n', o_orderkey)) group by 1")
def ingest_retries(spark, sf):
    """Notes that an earlier folder with the same payload holds already."""
    notes = table(spark, sf, "orders").select(F.concat(F.lit("n"), "o_orderkey").alias("slug"), F.col("o_custkey").alias("capture_hash"))
    seen = table(spark, sf, "customer").select(F.concat(F.lit("2024-"), "c_custkey", F.lit("-n"), "c_custkey").alias("folder"), F.col("c_custkey").alias("capture_hash"), F.col("c_custkey").alias("ord"))
    return ingest.retries(notes, seen)


def now():
    return F.lit(NOW).cast("timestamp")


def queue(spark, sf):
    return view(spark, sf, "queue").withColumn("ts", F.col("ts").cast("timestamp"))


@query("A1 S6 D14", cte("queue") + f"select queue, count(*) as count, cast(greatest(0, epoch(timestamp '{NOW}') - epoch(min(ts))) as bigint) as oldest_age_seconds from queue group by 1")
def queue_summary(spark, sf):
    return status.queue_summary(queue(spark, sf), now()).withColumn("oldest_age_seconds", F.col("oldest_age_seconds").cast("long"))


@query("A2 S7 U5", cte("queue") + "select slug, strftime(ts, '%Y-%m-%d') as day from queue where ts is not null order by ts desc, slug desc limit 1")
def queue_newest(spark, sf):
    q = queue(spark, sf)
    return status.newest_note(q.where("queue = 'inbox'"), q.where("queue = 'deferred'"), q.where("queue = 'curated'")).select("slug", F.date_format("ts", "yyyy-MM-dd").alias("day"))


@query("W12", cte("queue") + "select queue, slug, truncated from (select *, row_number() over (partition by queue order by ts nulls last, slug) as rn, count(*) over (partition by queue) > 20 as truncated from queue) where rn <= 20")
def queue_listed(spark, sf):
    return status.listed(queue(spark, sf), 20).select("queue", "slug", "truncated")


INBOX = "concat('---', chr(10), 'captured: 2024-01-01', chr(10), case when doc_id % 3 = 0 then '' else concat('session: s', chr(10)) end, 'topic: t', chr(10), '---', chr(10), 'body')"
PREPARED = """with pool as (select distinct folder from (select concat('f', doc_id) as folder from documents where doc_id % 3 <> 0 union all select concat('f', doc_id) from documents where doc_id % 7 = 0) where folder not in (select concat('f', doc_id) from documents where doc_id % 3 = 0))
, prepared as (select folder, case when row_number() over (order by folder) <= 4 then 'live' else 'held' end as state from pool union all select concat('f', doc_id), 'blocked' from documents where doc_id % 3 = 0) """


def prepared(spark, sf):
    docs = table(spark, sf, "documents")
    inbox = docs.select(F.concat(F.lit("f"), "doc_id").alias("folder"), F.expr(INBOX).alias("content"))
    return queues.prepare(inbox, docs.where("doc_id % 7 = 0").select(F.concat(F.lit("f"), "doc_id").alias("folder")))


@query("B1 W3 U2 P15", PREPARED + "select folder, state from prepared")
def queue_prepare(spark, sf):
    return prepared(spark, sf)


@query("B1", PREPARED + "select concat('pool=', count(*) filter (state <> 'blocked'), ' live=', count(*) filter (state = 'live'), ' held=', count(*) filter (state = 'held'), ' blocked=', count(*) filter (state = 'blocked'), ' cap=4') as line from prepared")
def queue_counts(spark, sf):
    return queues.counts_line(prepared(spark, sf))


REASONS = "['already-ingested', 'corrupt-input', 'unparseable-input', 'malformed-note', 'needs-operator-review', 'because']"


@query("B2 D15 P22", f"""select slug, case when not regexp_full_match(slug, '[A-Za-z0-9][A-Za-z0-9._-]{{0,199}}') then 'invalid-slug' when reason = 'because' then 'invalid-reason' when o_orderkey % 2 = 1 then 'blocked' when reason = 'already-ingested' then 'already-blocked' else 'conflict' end as result
from (select o_orderkey, case when o_orderkey % 17 = 0 then '../' else '' end || concat('Note_', o_orderkey, '.x') as slug, {REASONS}[o_orderkey % 6 + 1] as reason from orders)""")
def queue_receipts(spark, sf):
    reason = F.element_at(F.array(*map(F.lit, (*T.BLOCK_REASONS, "because"))), (F.col("o_orderkey") % 6 + 1).cast("int"))
    slug = F.concat(F.when(F.col("o_orderkey") % 17 == 0, "../").otherwise(""), F.lit("Note_"), "o_orderkey", F.lit(".x")).alias("slug")
    o = table(spark, sf, "orders")
    return queues.receipts(o.select(slug, reason.alias("reason")), o.where("o_orderkey % 2 = 0").select(slug, F.lit(T.BLOCK_REASONS[0]).alias("reason")))


@query("J18 W7 B3", cte("log_lines") + """
, s as (select *, coalesce(last_value(case when starts_with(line, '## [') then regexp_matches(line, '^## \\[[^\\]]*\\] (auto-)?ingest \\|') end ignore nulls) over (partition by file order by line_no rows between unbounded preceding and current row), false) as on_ from log_lines)
, w as (select distinct unnest(regexp_extract_all(line, '[A-Za-z0-9_-]+')) as slug from s where on_)
select concat('note-', range) as slug from range(400) where concat('note-', range) in (select slug from w)""")
def queue_already_ingested(spark, sf):
    return queues.already_ingested(view(spark, sf, "log_lines"), spark.range(400).select(F.concat(F.lit("note-"), "id").alias("slug")))


RUNS = "select user_id as session, event_id as seq, epoch(ts) as ts, case event_type when 'click' then 'tool_start' when 'view' then 'tool_end' when 'purchase' then 'turn_start' when 'signup' then 'auto_retry' else 'compaction' end as kind, event_id % 3 as call_id, event_id % 100 as tokens, value as cost, case when event_id % 17 = 0 then 'Boom' else '' end as error from events"


def runs(spark, sf):
    return table(spark, sf, "events").select(
        F.col("user_id").alias("session"), F.col("event_id").alias("seq"), F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"), (F.col("event_id") % 3).alias("call_id"), (F.col("event_id") % 100).alias("tokens"), F.col("value").alias("cost"),
        F.expr("case event_type when 'click' then 'tool_start' when 'view' then 'tool_end' when 'purchase' then 'turn_start' when 'signup' then 'auto_retry' else 'compaction' end").alias("kind"),
        F.when(F.col("event_id") % 17 == 0, "Boom").otherwise("").alias("error"),
    ).withColumn("ts", F.col("micros") / 1e6)


@query("W10 S21 D22", f"with r as ({RUNS}), p as (select *, lead(kind) over w as nk, lead(ts) over w as nt from r where kind in ('tool_start', 'tool_end') window w as (partition by session, call_id order by seq)) select session, seq, call_id, case when nk = 'tool_end' then round(nt - ts) end as seconds from p where kind = 'tool_start'")
def runs_tool_pairs(spark, sf):
    r = runs(spark, sf)
    pairs = queues.tool_runs(r).withColumnRenamed("started", "ts")
    return pairs.join(r.where("kind = 'tool_start'").select("session", "call_id", "ts", "seq"), ["session", "call_id", "ts"]).select("session", "seq", "call_id", F.round("seconds").alias("seconds"))


@query("A19", f"""with r as ({RUNS}) select session, sum(tokens) as tokens, round(sum(cost), 4) as cost, count(*) filter (kind = 'turn_start') as turns, count(*) filter (kind = 'tool_start') as tools, count(*) filter (kind = 'auto_retry') as retries,
count(*) filter (kind = 'compaction') as compactions, count(*) filter (error <> '') as errors, arg_max(kind, seq) as last_kind from r group by 1""")
def runs_totals(spark, sf):
    return queues.run_totals(runs(spark, sf)).withColumn("cost", F.round("cost", 4))


@query("M1 M7", cte("notes", "episodes") + ", w as (select slug, content_hash from episodes), n as (select distinct slug, sha256(body) as content_hash from notes) select n.slug, n.content_hash from n where not exists (select 1 from w where w.slug = n.slug and w.content_hash = n.content_hash)")
def ingest_unseen(spark, sf):
    """What a batch of notes adds to what was written before: the batch form of the streamed ingestion."""
    return ingest.unseen(view(spark, sf, "notes"), view(spark, sf, "episodes")).select("slug", "content_hash")


@query("X13", cte("episodes") + "select slug, content, created_at as valid_at from episodes where slug = '2024-01-03-023000-doc-2' and content is not null order by created_at desc, uuid desc limit 1")
def ingest_note(spark, sf):
    """A note by its slug, as its newest episode has it."""
    return ingest.note(view(spark, sf, "episodes"), "2024-01-03-023000-doc-2")


DROPS = """with docs as (select doc_id, text, case when doc_id % 7 = 0 then concat('Bad ', doc_id) else concat('doc-', doc_id) end as slug, case when doc_id % 11 = 0 then '  ' else text end as note_md from documents)
, asked as (select doc_id, 0 as again, slug, note_md from docs union all select doc_id, 1, slug, note_md from docs where doc_id % 3 = 0 union all select doc_id, 2, slug, concat(note_md, '!') from docs where doc_id % 4 = 0)
, bad as (select *, case when not regexp_full_match(slug, '[a-z0-9][a-z0-9-]{0,63}') then 'slug' when coalesce(regexp_replace(note_md, '\\s+', '', 'g'), '') = '' then 'empty note' when strlen(note_md) > 262144 then 'note too large' end as error from asked)
, known as (select *, case when error is null and again < 2 and doc_id % 5 = 0 then concat('2023-01-01-000000-doc-', doc_id) end as old, concat('2024-01-0', again + 1, '-030405-', slug) as new from bad)
select slug, coalesce(old, case when again = 1 and error is null then replace(new, '01-02-', '01-01-') end, new) as folder, error is null as ok, error is null and (old is not null or again = 1) as already_exists, error from known"""


@query("S15 J12 M8 P9 P13", DROPS)
def ingest_drops(spark, sf):
    """Dropped notes: refused, known from before under the same slug, repeated, or new (also where a foreign slug has the
    same text)."""
    d = table(spark, sf, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("Bad "), "doc_id")).otherwise(F.concat(F.lit("doc-"), "doc_id")).alias("slug"), F.when(F.col("doc_id") % 11 == 0, "  ").otherwise(F.col("text")).alias("note_md"))
    none = [F.lit(None).cast("map<string,string>").alias(c) for c in ("texts", "binaries")]
    at = lambda n: F.lit(f"2024-01-0{n + 1} 03:04:05").cast("timestamp").alias("at")
    asked = d.select("slug", "note_md", *none, at(0)).unionByName(d.where("doc_id % 3 = 0").select("slug", "note_md", *none, at(1))).unionByName(d.where("doc_id % 4 = 0").select("slug", F.concat("note_md", F.lit("!")).alias("note_md"), *none, at(2)))
    held = T.payload_hash(F.col("note_md"), F.lit(None).cast("map<string,string>"), F.lit(None).cast("map<string,binary>")).alias("capture_hash")
    seen = d.where("doc_id % 5 = 0").select(F.concat(F.lit("2023-01-01-000000-doc-"), "doc_id").alias("folder"), held).unionByName(d.where("doc_id % 5 = 1").select(F.concat(F.lit("2023-01-01-000000-other-"), "doc_id").alias("folder"), held))
    return files.decide_drops(asked, seen).select("slug", "folder", F.col("error").isNull().alias("ok"), "already_exists", "error")
