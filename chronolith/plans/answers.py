"""Queries over evidence packets and grounded answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronolith.functions import plugins
from chronolith.functions import text as T
from chronolith.operators import grounding, search

from .registry import query
from .workload import table

CANDIDATES = """select event_id, case event_id % 5 when 0 then 'high' when 1 then 'Medium' when 2 then 'low' when 3 then 'not_found' else 'sure' end as confidence, case when event_id % 7 = 0 then null else concat('answer ', event_id) end as answer,
  concat('s', event_id % 4) as a, concat('s', event_id % 6) as b, case when event_id % 2 = 0 then 'none' else 'was else' end as superseded_note, event_id % 9 = 0 as escalate from events"""


def grounded(spark, sf):
    c = spark.sql(CANDIDATES.replace("from events", "from {events}"), events=table(spark, sf, "events"))
    known = lambda *v: F.array(*map(F.lit, v))
    return grounding.ground(c.withColumns({"sources": F.array("a", "b"), "strong": known("s0", "s1"), "weak": known("s2")}))


GROUND = f"""with c as ({CANDIDATES}), k as (select *, case when lower(confidence) in ('high', 'medium', 'low', 'not_found') then lower(confidence) else 'low' end as conf, a in ('s0', 's1', 's2') as ka, b in ('s0', 's1', 's2') as kb from c)
, g as (select *, conf = 'not_found' or answer is null as abstains, not ka and not kb as rejects, conf = 'high' and not ((ka and a <> 's2') or (kb and b <> 's2')) as weak from k)
, grounded as (select event_id, abstains or not rejects as grounded, case when abstains then 'abstained' when rejects then 'rejected' when weak then 'downgraded' when not (ka and kb) then 'filtered' else 'accepted' end as action,
  case when abstains or rejects then 'not_found' when weak then 'medium' else conf end as confidence, case when not (abstains or rejects) then answer end as answer,
  case when abstains or rejects then '' when ka and kb and a <> b then concat(a, ',', b) when ka then a else b end as sources,
  case when not (abstains or rejects) and superseded_note <> 'none' then superseded_note end as superseded_note, case when abstains or rejects then true else escalate end as escalate from g) """


@query("X16 J16 U7 D12", GROUND + "select * from grounded")
def answers_ground(spark, sf):
    """Candidate answers, kept to what their evidence supports."""
    return grounded(spark, sf).select("event_id", "grounded", "action", "confidence", "answer", F.array_join("sources", ",").alias("sources"), "superseded_note", "escalate")


@query("A24", GROUND + "select x.action, count(g.event_id) as n from (values ('accepted'), ('filtered'), ('downgraded'), ('rejected'), ('abstained'), ('error')) x(action) left join grounded g on g.action = x.action group by 1")
def answers_action_counts(spark, sf):
    return grounding.action_counts(grounded(spark, sf))


HITS = "select user_id % 20 as query_id, event_id, case event_type when 'click' then 'fact' when 'view' then 'entity' when 'purchase' then 'community' when 'signup' then 'episode' else 'semantic' end as kind, row_number() over (partition by user_id % 20, event_type order by value desc, event_id) as rank, concat('n', event_id % 50) as name, concat('text ', event_id) as text, concat('s', event_id % 6) as source_slug, event_id % 3 <> 0 as current, value / 200.0 as score from events"


def hits(spark, sf):
    return spark.sql(HITS.replace("from events", "from {events}"), events=table(spark, sf, "events"))


@query("O7 X9 W6", f"with h as ({HITS}) select query_id, kind, event_id from h where rank <= case kind when 'fact' then 8 when 'entity' then 8 when 'community' then 3 when 'episode' then 2 else 3 end")
def answers_capped_hits(spark, sf):
    return search.capped(hits(spark, sf), 8).select("query_id", "kind", "event_id")


@query("X9 D11 J14", f"with h as ({HITS}) select query_id, count(*) filter (kind = 'fact' and rank <= 8) as facts, count(*) filter (kind = 'entity' and rank <= 8) as entities, count(*) filter (kind = 'community' and rank <= 3) as communities, count(*) filter (kind = 'semantic' and rank <= 3) as semantic_notes, min(name) filter (kind = 'episode' and rank = 1) as excerpt from h group by 1")
def answers_packet(spark, sf):
    """One nested packet for each question; here its sizes."""
    p = search.packet(hits(spark, sf), 8)
    return p.select("query_id", *[F.size(c).cast("long").alias(c) for c in ("facts", "entities", "communities", "semantic_notes")], F.col("source_excerpt.slug").alias("excerpt"))


@query("X15", f"""with h as ({HITS}), s as (select query_id, source_slug as slug, current as strong from h where kind = 'fact' and rank <= 8 union all select query_id, name, true from h where kind = 'episode' and rank = 1 union all select query_id, name, false from h where kind = 'semantic' and rank <= 3)
select query_id, slug, bool_or(strong) as strong from s group by 1, 2""")
def answers_strengths(spark, sf):
    return grounding.strengths(search.packet(hits(spark, sf), 8))


@query("X14 F2", f"with h as ({HITS}), f as (select query_id, min(rank) as rank from h where kind = 'fact' and rank <= 8 and current group by 1) select q.query_id, case when f.rank is null then 'not_found' else 'medium' end as confidence, h.text as answer from (select distinct query_id from h) q left join f on f.query_id = q.query_id left join h on h.query_id = q.query_id and h.kind = 'fact' and h.rank = f.rank")
def answers_extractive(spark, sf):
    """The default distiller: the first current fact of each packet."""
    return plugins.extractive_answer(search.packet(hits(spark, sf), 8)).select("query_id", "confidence", "answer")


@query("F3", """with lines as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from documents where text is not null)
, said as (select doc_id, pos, trim(line) as fact from lines where trim(line) <> '') select doc_id, cast(row_number() over (partition by doc_id order by pos) - 1 as bigint) as ord, concat(fact, ' [[doc-', doc_id, '|it]]') as fact, concat('doc-', doc_id) as entity from said""")
def answers_claims(spark, sf):
    """Each line of a text as a durable claim about the document, extracted from the note that holds them."""
    claims = F.array_join(F.transform(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""), lambda x: F.concat(F.lit("- "), F.trim(x), F.lit(" [[doc-"), F.col("doc_id").cast("string"), F.lit("|it]]"))), "\n")
    notes = table(spark, sf, "documents").where("text is not null").select(F.col("doc_id").alias("slug"), F.concat(F.lit("# t\n\n## Durable claims\n\n"), claims, F.lit("\n\n## Rest\n\n- no\n")).alias("body"))
    found = plugins.extract_claims(notes)
    return found.select(F.col("slug").alias("doc_id"), F.col("ord").cast("long").alias("ord"), "fact", F.element_at("entities", -1).alias("entity"))


REPLY = "case event_id % 5 when 0 then concat('```json', chr(10), '{\"answer\": ', event_id, '}', chr(10), '```') when 1 then concat('I think {\"answer\": ', event_id, '} is it') when 2 then concat('{\"answer\": {\"answer\": {\"answer\": ', event_id, '}}}') when 3 then concat('no { json', event_id) else concat('[{\"answer\": ', event_id, '}]') end"


@query("P21 P35", "select event_id, case when event_id % 5 = 3 then null else event_id end as answer from events")
def answers_parsed(spark, sf):
    """What models reply, fenced, in the middle of prose, wrapped or broken, as the number it holds."""
    found = T.unwrapped(T.json_object(F.expr(REPLY)))
    return table(spark, sf, "events").select("event_id", F.get_json_object(found, "$.answer").cast("long").alias("answer"))


CACHED = GROUND + """
, kept as (select concat('what is item ', event_id % 97) as question_key, answer, confidence from grounded where grounded and coalesce(answer, '') <> '' and confidence in ('high', 'medium', 'low'))
, cache as (select question_key, max(answer) as answer, arg_max(confidence, answer) as confidence from kept group by 1)
, asked as (select event_id, concat('what is item ', event_id % 120) as question_key from events where event_id % 3 = 0)"""


@query("X17", CACHED + " select a.event_id, c.answer is not null as hit, c.answer, c.confidence from asked a left join cache c using (question_key)")
def answers_cache(spark, sf):
    """Questions against the cache that the grounded answers of the same state of the graph have filled."""
    g = grounded(spark, sf).withColumn("question", F.concat(F.lit("What  is item "), F.col("event_id") % 97, F.lit(" ?")))
    none = spark.createDataFrame([], "question_key string, watermark string, expires_at long, answer string, confidence string, sources array<string>")
    cache = grounding.remember(none, g, "2024-03-19", F.lit(1000).cast("long"))
    asked = table(spark, sf, "events").where("event_id % 3 = 0").select("event_id", F.concat(F.lit(" what is ITEM "), F.col("event_id") % 120, F.lit("?!")).alias("question"))
    return grounding.cached(asked, cache, "2024-03-19", F.lit(2000).cast("long")).select("event_id", "hit", "answer", "confidence")


@query("F1 P8")
def answers_embeddings(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", plugins.hashing_embedder()(F.col("text")).alias("vector"))
