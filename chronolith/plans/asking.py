"""Queries that search the graph by four kinds of evidence, and answer questions from it."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronolith.operators import answer

from .knowledge import DOT
from .registry import query
from .workload import cte, table, view

GROUP = 1
#: Every row in one of two groups; ids, what words are matched, what is shown.
FACTS = f"select uuid as id, fact as words, concat('customer ', subject, ' in ', year(valid_at)) as name, fact as text, concat('note-', uuid) as source_slug, invalid_at is null as current, valid_at, invalid_at from {{facts}} where uuid % 2 = {GROUP}"
ENTITIES = f"select c_custkey as id, concat(replace(c_name, '#', ' '), ' customer ', c_custkey) as words, c_name as name, c_mktsegment as text from {{customer}} where c_custkey % 2 = {GROUP}"
EPISODES = f"select doc_id as id, concat('customer ', doc_id % 60, ' ', substr(text, 1, 200)) as words, concat('note-', doc_id) as name, text from {{documents}} where doc_id % 2 = {GROUP}"
COMMUNITIES = "select n_nationkey as id, concat(n_name, ' customer ', n_nationkey) as words, n_name as name, concat('about ', n_name) as text from {nation}"
KINDS = {"fact": FACTS, "entity": ENTITIES, "episode": EPISODES, "community": COMMUNITIES}
QUESTIONS = "select c_custkey as query_id, concat('What does customer ', c_custkey, ' prefer?') as question from {customer} where c_custkey % 2 = 1 and c_custkey < 60"


def named(spark, sf, sql):
    tables = {n: view(spark, sf, n) if n == "facts" else table(spark, sf, n) for n in ("facts", "customer", "documents", "nation") if f"{{{n}}}" in sql}
    return spark.sql(sql, **tables)


def kinds(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return {k: named(spark, sf, sql) if k == "episode" else named(spark, sf, sql).join(e, "id", "left") for k, sql in KINDS.items()}


def questions(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return named(spark, sf, QUESTIONS).join(e, "query_id", "left")


def kind_sql(kind: str, k: int) -> str:
    """One kind's fused ranks in SQL."""
    rows = KINDS[kind].replace("{", "").replace("}", "")
    lists = f"select query_id, id, rank from {kind}_bm where rank <= {2 * k}" + ("" if kind == "episode" else f" union all select query_id, id, rank from {kind}_v where rank <= {2 * k}")
    vectors = "" if kind == "episode" else f"""
, {kind}_vs as (select b.vec_id as query_id, a.vec_id as id, round({DOT}, 6) as score from embeddings a, embeddings b where a.vec_id in (select id from {kind}_r) and b.vec_id in (select query_id from q))
, {kind}_v as (select query_id, id, row_number() over (partition by query_id order by score desc, id) as rank from {kind}_vs)"""
    return f""", {kind}_r as ({rows}), {kind}_w as (select id, regexp_extract_all(lower(coalesce(words, '')), '[a-z0-9]+') as w from {kind}_r), {kind}_st as (select count(*) as n, avg(len(w)) as avgdl from {kind}_w)
, {kind}_tf as (select id, dl, term, count(*) as tf from (select id, len(w) as dl, unnest(w) as term from {kind}_w) where term in (select term from asked) group by 1, 2, 3), {kind}_df as (select term, count(*) as df from {kind}_tf group by 1)
, {kind}_sc as (select query_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) as score from {kind}_tf join {kind}_df using (term) join asked using (term), {kind}_st group by 1, 2)
, {kind}_bm as (select query_id, id, row_number() over (partition by query_id order by score desc, id) as rank from {kind}_sc){vectors}
, {kind}_f as (select query_id, id, round(sum(1 / (60.0 + rank)), 9) as score from ({lists}) group by 1, 2)
, {kind}_top as (select * from (select *, row_number() over (partition by query_id order by score desc, id) as rank from {kind}_f) where rank <= {k})"""


ASKED = cte("facts") + f", q as ({QUESTIONS.replace('{', '').replace('}', '')}), asked as (select distinct query_id, unnest(regexp_extract_all(lower(question), '[a-z0-9]+')) as term from q)"


@query("X6 X7 J13", ASKED + "".join(kind_sql(k, 8) for k in KINDS) + " union all ".join(f"{' ' if k == 'fact' else ''}select query_id, '{k}' as kind, rank, cast(id as varchar) as id, score from {k}_top" for k in KINDS))
def search_graph(spark, sf):
    """Facts, entities, episodes (by words alone) and communities of a group, each by fused words and vectors."""
    asked = questions(spark, sf).withColumnRenamed("question", "query")
    return answer.graph_search(kinds(spark, sf), asked).select("query_id", "kind", "rank", "id", "score")


@query("X18", ASKED + kind_sql("fact", 5) + " select t.query_id, t.rank, t.score, r.text as fact, r.invalid_at is null as current from fact_top t join fact_r r on r.id = t.id")
def search_facts(spark, sf):
    """Facts only."""
    asked = questions(spark, sf).withColumnRenamed("question", "query")
    return answer.facts_only(kinds(spark, sf)["fact"], asked).select("query_id", "rank", "score", "fact", F.col("invalid_at").isNull().alias("current"))


@query("X14 X17 F2 M6", ASKED + kind_sql("fact", 8) + """
, c as (select t.query_id, r.text as answer, r.source_slug, row_number() over (partition by t.query_id order by t.rank) as n from fact_top t join fact_r r on r.id = t.id where r.current)
, one as (select q.query_id, c.answer, case when c.answer is null then 'not_found' else 'medium' end as confidence, coalesce(c.source_slug, '') as sources, case when c.answer is null then 'abstained' else 'accepted' end as action from q left join c on c.query_id = q.query_id and c.n = 1)
select run, query_id, answer, confidence, sources, action, run = 2 and answer is not null as cached from one cross join (select unnest([1, 2, 3]) as run)""")
def answers_direct(spark, sf):
    """The questions three times: from packets, from the cache in other words, and, as the graph has changed, from packets."""
    said = questions(spark, sf)
    k, now = kinds(spark, sf), lambda t: F.lit(t).cast("long")
    notes = table(spark, sf, "embeddings").select(F.concat(F.lit("page-"), "vec_id").alias("name"), F.lit("a page").alias("description"), F.col("embedding").alias("vector"))
    first = answer.answer(said, k, notes, "2024-03-19", now(1000))
    again = answer.answer(said.withColumn("question", F.concat(F.lit("  "), F.upper("question"), F.lit("? "))), k, notes, "2024-03-19", now(2000), first.cache)
    changed = answer.answer(said, k, notes, "2024-03-20", now(2500), again.cache)
    runs = [a.answers.withColumn("run", F.lit(n)) for n, a in enumerate((first, again, changed), 1)]
    both = runs[0].unionByName(runs[1]).unionByName(runs[2])
    return both.select("run", "query_id", "answer", "confidence", F.array_join("sources", ",").alias("sources"), "action", "cached")
