"""Queries over facts, entities, graphs and vectors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronolith.functions import text as T
from chronolith.operators import community, facts, resolve, search

from .registry import query
from .workload import cte, table, view

NOW = "1999-06-01"
DAY = "strftime({}, '%Y-%m-%d')"


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def day(column: str):
    return F.date_format(column, "yyyy-MM-dd").alias(column)


@query("W5 P10 D7", cte("facts") + f"select subject, fact, {DAY.format('valid_at')} as valid_at from facts where invalid_at is null")
def facts_current(spark, sf):
    """What is true now about each subject."""
    return view(spark, sf, "facts").where(facts.is_current()).select("subject", "fact", day("valid_at"))


@query("W5", "select o_orderkey as uuid, strftime(lead(o_orderdate) over (partition by o_custkey order by o_orderdate, o_orderkey), '%Y-%m-%d') as invalid_at from orders")
def facts_close_intervals(spark, sf):
    raw = table(spark, sf, "orders").select(F.col("o_orderkey").alias("uuid"), F.col("o_custkey").alias("subject"), F.col("o_orderdate").alias("valid_at"))
    return facts.close_intervals(raw, "subject").select("uuid", day("invalid_at"))


@query("J17", cte("facts") + f"select subject, uuid, fact from facts where valid_at <= timestamp '{NOW}' and (invalid_at is null or invalid_at > timestamp '{NOW}')")
def facts_as_of(spark, sf):
    return facts.as_of(view(spark, sf, "facts"), now()).select("subject", "uuid", "fact")


@query("J17", cte("facts") + "select l.l_orderkey, l.l_linenumber, f.object from lineitem l join orders o on o.o_orderkey = l.l_orderkey join facts f on f.subject = o.o_custkey and f.valid_at <= l.l_shipdate and (f.invalid_at is null or f.invalid_at > l.l_shipdate)")
def facts_as_of_join(spark, sf):
    """Each line item with the fact about its customer that held when it was shipped."""
    lines, orders = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    points = lines.join(orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("subject")), "l_orderkey").select("l_orderkey", "l_linenumber", "l_shipdate", "subject")
    told = view(spark, sf, "facts").select("uuid", "subject", "object", "valid_at", "invalid_at")
    return facts.as_of_merge(points, told, "subject", "l_shipdate", rows=lines.count() + orders.count()).select("l_orderkey", "l_linenumber", "object")


@query("J17", cte("facts") + "select l.l_orderkey, l.l_linenumber, f.object from lineitem l join orders o on o.o_orderkey = l.l_orderkey join facts f on f.subject = o.o_custkey and f.valid_at <= l.l_shipdate and (f.invalid_at is null or f.invalid_at > l.l_shipdate)")
def facts_as_of_overlapping(spark, sf):
    """The same by the join that also allows for facts that overlap."""
    points = table(spark, sf, "lineitem").join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("subject")), "l_orderkey")
    return facts.as_of_join(points.select("l_orderkey", "l_linenumber", "l_shipdate", "subject"), view(spark, sf, "facts"), "subject", "l_shipdate").select("l_orderkey", "l_linenumber", "object")


CHANGES = cte("facts") + f"""
, mine as (select fact, cast(valid_at as varchar) as valid_at, cast(invalid_at as varchar) as invalid_at, valid_at as v, invalid_at as i from facts
  where contains(lower(fact), 'customer 1') or contains(lower(subject_name), 'customer 1') or contains(lower(object_name), 'customer 1'))
select * from (select 'new' as kind, * from (select distinct fact, valid_at, invalid_at from mine where v >= timestamp '{NOW}' - interval 300 day) order by valid_at desc nulls first, fact, valid_at limit 25)
union all
select * from (select 'superseded' as kind, * from (select distinct fact, valid_at, invalid_at from mine where i >= timestamp '{NOW}' - interval 300 day) order by invalid_at desc nulls first, fact, valid_at limit 15)"""


@query("X12 J6 A22 O4 O5 T7", CHANGES)
def facts_changes(spark, sf):
    return facts.changes(view(spark, sf, "facts"), "Customer 1", now(), 300)


@query("X11 J5 O3 K5", cte("facts") + """
, near as (select src as node, dst as other, fact, valid_at, uuid from facts where invalid_at is null union all select dst, src, fact, valid_at, uuid from facts where invalid_at is null)
select '1-URGENT' as name, fact, other, strftime(valid_at, '%Y-%m-%d') as valid_at, uuid as edge from near where node = '1-URGENT' order by near.valid_at desc nulls first, uuid, other limit 25""")
def facts_of_entity(spark, sf):
    f = view(spark, sf, "facts")
    names = f.select(F.explode(F.array("src", "dst")).alias("uuid")).distinct().withColumn("name", F.col("uuid"))
    return facts.entity_facts(names, f, "1-urgent").select("name", "fact", "other", day("valid_at"), "edge")


@query("O6 X10", cte("facts") + """
, hits as (select *, row_number() over (order by valid_at desc, uuid) as rank from facts where contains(fact, '2-HIGH'))
select rank, uuid, fact from (select * from hits where rank <= 15) where invalid_at is null order by rank limit 10""")
def facts_current_of_hits(spark, sf):
    f = view(spark, sf, "facts").where(F.contains("fact", F.lit("2-HIGH"))).orderBy(F.desc("valid_at"), "uuid").limit(facts.HITS)
    return facts.current_of_hits(f.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("valid_at"), "uuid")))).select("rank", "uuid", "fact")


@query("J2 P11", cte("facts") + "select f.uuid, coalesce(n.name, '') as source_slug from facts f left join (select concat('e', doc_id) as e, concat('doc-', doc_id) as name from documents) n on n.e = concat('e', f.uuid)")
def facts_provenance(spark, sf):
    f = view(spark, sf, "facts").withColumn("episodes", F.array(F.concat(F.lit("e"), "uuid")))
    names = table(spark, sf, "documents").select(F.concat(F.lit("e"), "doc_id").alias("uuid"), F.concat(F.lit("doc-"), "doc_id").alias("name"))
    return facts.provenance(f, names).select("uuid", "source_slug")


@query("A7 O10", cte("facts") + "select entity, count(*) as n from (select src as entity from facts where invalid_at is null union all select dst from facts where invalid_at is null) group by 1 order by n desc, entity limit 12")
def facts_density(spark, sf):
    return facts.density(view(spark, sf, "facts"), 12)


PAIRS = cte("facts") + """
, j as (select *, row_number() over (partition by subject order by valid_at, uuid) as rn from facts where valid_at is not null)
, p as (select a.subject, a.uuid as older, b.uuid as newer, b.valid_at as closes_at from j a join j b on a.subject = b.subject and a.rn <= 40 and b.rn <= 40 and a.object <> b.object and a.valid_at < b.valid_at) """


@query("J9 O9 K21", PAIRS + f"select subject, older, newer, {DAY.format('closes_at')} as closes_at from p")
def facts_contradictions(spark, sf):
    return facts.contradictions(view(spark, sf, "facts")).select("subject", "older", "newer", day("closes_at"))


@query("F5 J9", cte("facts") + """, l as (select *, row_number() over (partition by subject order by valid_at, uuid) - 1 as place from facts where valid_at is not null and invalid_at is null or uuid % 3 = 0), k as (select * from l where place < 40)
select a.subject, a.uuid as older, b.uuid as newer from k a join k b on a.subject = b.subject and b.place = a.place + 2 and a.valid_at < b.valid_at""")
def facts_judged(spark, sf):
    """Pairs by a judge of one's own: each listed fact against the one two places on, said twice and with places that no fact has."""
    f = view(spark, sf, "facts").where("valid_at is not null and invalid_at is null or uuid % 3 = 0")

    def judge(listed):
        places = listed.select("subject", F.explode(F.sequence(F.lit(0), F.size("facts"))).alias("i"))
        return places.select("subject", "i", (F.col("i") + 2).alias("j")).unionByName(places.select("subject", (F.col("i") + 2).alias("i"), F.col("i").alias("j")))

    return facts.judged_contradictions(f, judge).select("subject", "older", "newer")


@query("T5 S16", PAIRS + f"select f.uuid, {DAY.format('coalesce(c.closes_at, f.invalid_at)')} as invalid_at, c.closes_at is not null as expired from facts f left join (select older, min(closes_at) as closes_at from p group by 1) c on c.older = f.uuid")
def facts_close_contradicted(spark, sf):
    f = view(spark, sf, "facts")
    return facts.close_contradicted(f, facts.contradictions(f), now()).select("uuid", day("invalid_at"), F.col("expired_at").isNotNull().alias("expired"))


KEY = "regexp_replace(regexp_replace(lower(trim({})), '\\.(ri\\.gd|com|com\\.br|ia\\.br|dev\\.br)$', ''), '[^a-z0-9]+', '', 'g')"


@query("J7 P23 K4 G4", cte("entities") + f"""
, k as (select *, {KEY.format('name')} as key from entities), r as (select *, row_number() over (partition by key order by -length(coalesce(summary, '')), uuid) as rn from k where key <> '')
select c.uuid as canonical, d.uuid as duplicate from r d join r c on c.key = d.key and c.rn = 1 where d.rn > 1""")
def entities_same_key(spark, sf):
    return resolve.same_key(view(spark, sf, "entities"))


GENERIC = "('cluster', 'service', 'server', 'app', 'site', 'project', 'the', 'instance')"


@query("J8 P24 K18 U6 G4", cte("entities") + f"""
, n as (select lower(name) as low, min(name) as name from entities group by 1)
, p as (select s.name as shorter, l.name as longer, regexp_extract_all(concat(substr(l.low, 1, instr(l.low, s.low) - 1), substr(l.low, instr(l.low, s.low) + length(s.low))), '[a-z0-9]+') as rest
  from n s join n l on s.low <> l.low and (starts_with(l.low, s.low) or ends_with(l.low, s.low)) and length(l.name) - length(s.name) <= 12)
select distinct shorter, longer from p where len(rest) > 0 and len(list_filter(rest, lambda t: t not in {GENERIC})) = 0""")
def entities_generic_names(spark, sf):
    return resolve.generic_names(view(spark, sf, "entities"))


NAMED = f"""
, n as (select lower(name) as low, min(name) as name, min(uuid) as uuid from entities group by 1)
, p as (select s.uuid as a, l.uuid as b, s.name as shorter, l.name as longer, regexp_extract_all(concat(substr(l.low, 1, instr(l.low, s.low) - 1), substr(l.low, instr(l.low, s.low) + length(s.low))), '[a-z0-9]+') as rest
  from n s join n l on s.low <> l.low and (starts_with(l.low, s.low) or ends_with(l.low, s.low)) and length(l.name) - length(s.name) <= 12)
, g as (select distinct a, b, shorter, longer from p where len(rest) > 0 and len(list_filter(rest, lambda t: t not in {GENERIC})) = 0)"""
ROOTS = cte("entities").replace("with ", "with recursive ", 1) + NAMED + f"""
, k as (select uuid, {KEY.format('name')} as key from entities)
, near as (select min(uuid) over (partition by key) as a, uuid as b from k where key <> '' union select n.uuid, e.uuid from entities e join n on n.low = lower(e.name) union select a, b from g)
, links as (select a, b from near where a <> b union select b, a from near where a <> b)
, reach as (select distinct a as id, a as at from links union select r.id, l.b from reach r join links l on l.a = r.at)
, m as (select r.id, arg_min(e.uuid, (-length(coalesce(e.summary, '')), e.uuid)) as root from reach r join entities e on e.uuid = r.at group by 1) """


def groups(spark, sf):
    e = view(spark, sf, "entities")
    return resolve.merge_groups(resolve.candidates(e), e)


@query("G6 K22 J19 G5 F4 G4", ROOTS + "select id, root from m")
def entities_merge_groups(spark, sf):
    """Entities of equal keys or of names that add generic words, with the one of the longest summary."""
    return groups(spark, sf)


@query("O12 G5", cte("entities") + NAMED + " select shorter, longer from (select shorter, longer from g order by shorter, longer limit 120) order by shorter, longer limit 40")
def entities_merge_run(spark, sf):
    """The merges that one run confirms: a stated cap."""
    return resolve.confirmed(view(spark, sf, "entities"))


MOVED = "select concat('p', l_partkey) as src, concat('s', l_suppkey) as dst, l_orderkey * 10 + l_linenumber as uuid from lineitem"


@query("J19 G6", ROOTS + f", e as ({MOVED}) select e.uuid, coalesce(a.root, e.src) as src, coalesce(b.root, e.dst) as dst from e left join m a on a.id = e.src left join m b on b.id = e.dst where not ((a.root is not null or b.root is not null) and coalesce(a.root, e.src) = coalesce(b.root, e.dst))")
def entities_repoint_edges(spark, sf):
    e = table(spark, sf, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("uuid"))
    return resolve.repoint(e, groups(spark, sf)).select("uuid", "src", "dst")


@query("G6 D8", ROOTS + "select distinct concat('e', l_orderkey) as episode_uuid, coalesce(m.root, concat('p', l_partkey)) as entity_uuid from lineitem left join m on m.id = concat('p', l_partkey)")
def entities_repoint_mentions(spark, sf):
    m = table(spark, sf, "lineitem").select(F.concat(F.lit("e"), "l_orderkey").alias("episode_uuid"), F.concat(F.lit("p"), "l_partkey").alias("entity_uuid"))
    return resolve.repoint_mentions(m, groups(spark, sf))


TRADE = """with trade as (select s_nationkey as src, c_nationkey as dst from lineitem join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey join supplier on s_suppkey = l_suppkey where s_nationkey <> c_nationkey)
, both_ as (select src, dst from trade union all select dst, src from trade), adj as materialized (select src, dst, count(*) as weight from both_ group by 1, 2) """


def trade(spark, sf):
    """An edge for each line item that goes from one nation to another."""
    line = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey")
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey").join(table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("dst")), "o_custkey")
    pairs = line.join(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("src")), "l_suppkey").join(o, "l_orderkey")
    return pairs.where("src <> dst").select("src", "dst")


@query("A8 G1", TRADE + "select n_nationkey as src, dst, coalesce(weight, 0) as weight from nation left join adj on adj.src = n_nationkey")
def graph_adjacency(spark, sf):
    return community.adjacency(table(spark, sf, "nation").select(F.col("n_nationkey").alias("node")), trade(spark, sf))


def rounds_sql(n: int) -> str:
    steps = [", l0 as materialized (select n_nationkey as node, cast(row_number() over (order by n_nationkey) - 1 as bigint) as label from nation)"]
    for k in range(n):
        steps.append(f""", r{k} as materialized (select a.src as node, l.label, sum(a.weight) as rank from adj a join l{k} l on l.node = a.dst group by 1, 2)
, b{k} as materialized (select *, row_number() over (partition by node order by rank desc, label desc) as rn from r{k})
, l{k + 1} as materialized (select l.node, case when b.node is null then l.label when b.rank > 1 then b.label else greatest(b.label, l.label) end as label from l{k} l left join b{k} b on b.node = l.node and b.rn = 1)""")
    return " ".join(steps) + f" select node, label from l{n}"


@query("G2 K10", TRADE + rounds_sql(community.ROUNDS))
def graph_label_propagation(spark, sf):
    return community.label_propagation(community.adjacency(table(spark, sf, "nation").select(F.col("n_nationkey").alias("node")), trade(spark, sf)))


@query("G2", TRADE + rounds_sql(7))
def graph_active_propagation(spark, sf):
    """Seven rounds over what moved only."""
    return community.propagate_active(community.adjacency(table(spark, sf, "nation").select(F.col("n_nationkey").alias("node")), trade(spark, sf)), 7)


@query("G3", """with m as (select c_nationkey as community, c_custkey as node, c_name as summary, row_number() over (partition by c_nationkey order by c_custkey) as rn from customer)
select community, count(*) as members, substr(string_agg(summary, '; ' order by node) filter (rn <= 5), 1, 60) as name, string_agg(summary, '; ' order by node) filter (rn <= 5) as summary from m group by 1""")
def graph_community_summaries(spark, sf):
    m = table(spark, sf, "customer").select(F.col("c_nationkey").alias("community"), F.col("c_custkey").alias("node"), F.col("c_name").alias("summary"))
    return community.summaries(m, cap=10**9)


JOINED = "case when length({0}) <= 400 then {0} when regexp_matches(left({0}, 400), '(?s)^.*\\.') then regexp_extract(left({0}, 400), '(?s)^(.*\\.)', 1) else left({0}, 400) end"


@query("A25 F6 G3", f"""with recursive s as (select c_nationkey as community, concat(c_name, ' buys for ', c_mktsegment, '.') as summary, row_number() over (partition by c_nationkey order by c_custkey) as rn from customer)
, t as (select community, list(summary order by rn) as l from s where rn <= 200 group by 1
  union all select community, list_concat(list_transform(range(1, len(l) // 2 + 1), lambda i: {JOINED.format("concat(l[i], ' ', l[i + len(l) // 2])")}), l[len(l) // 2 * 2 + 1 :]) from t where len(l) > 1)
select community, {JOINED.format('l[1]')} as summary from t where len(l) = 1""")
def graph_tree_summaries(spark, sf):
    """Summaries of at most 200 members, combined pair by pair."""
    m = table(spark, sf, "customer").select(F.col("c_nationkey").alias("community"), F.col("c_custkey").alias("ord"), F.concat("c_name", F.lit(" buys for "), "c_mktsegment", F.lit(".")).alias("summary"))
    first = m.withColumn("rn", F.row_number().over(Window.partitionBy("community").orderBy("ord"))).where(F.col("rn") <= community.MEMBERS)
    return community.tree_reduce(first)


@query("W11 K11")
def graph_member_sample(spark, sf):
    m = table(spark, sf, "customer").select(F.col("c_nationkey").alias("community"), F.col("c_custkey").alias("node"))
    return community.sample_members(m, 20)


DOT = "list_sum(list_transform(range(1, 65), lambda i: cast(a.embedding[i] as double) * cast(b.embedding[i] as double)))"


@query("X1 O1 W6", f"""with s as (select b.vec_id as query_id, a.vec_id as id, round({DOT}, 6) as score from embeddings a, embeddings b where b.vec_id % 50 = 0)
select * from (select *, row_number() over (partition by query_id order by score desc, id) as rank from s) where rank <= 10""")
def search_vectors(spark, sf):
    """The query set (every 50th vector) against all rows."""
    e = table(spark, sf, "embeddings")
    return search.vector_search(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), 10)


Q = "the er thth-on of"
HIT = "len(list_filter(t, lambda x: contains(lower({}), x)))"


@query("X2 A20 O2", f"""with q as (select list_distinct(regexp_extract_all(lower('{Q}'), '[a-z0-9][a-z0-9_.-]+')) as t), d as (select doc_id, concat('doc-', doc_id) as name, substr(text, 1, 80) as description, source as tags, text as body from documents)
, s as (select name, (3.0 * {HIT.format('name')} + 2.0 * {HIT.format('description')} + {HIT.format('body')}) / len(t) + case when contains(lower(name), '{Q}') then 3 when contains(lower(description), '{Q}') then 2 else 0 end + case when tags <> '' then {HIT.format('tags')} / len(t) else 0 end as score from d, q)
select name, round(score, 6) as score from s where score > 0 order by s.score desc, lower(name) limit 25""")
def search_lexical(spark, sf):
    d = table(spark, sf, "documents").select(F.concat(F.lit("doc-"), "doc_id").alias("name"), F.substring("text", 1, 80).alias("description"), F.col("source").alias("tags"), F.col("text").alias("body"))
    return search.lexical_search(d, Q, 25).select("name", F.round("score", 6).alias("score"))


LEXICAL = f"""with q as (select list_distinct(regexp_extract_all(lower('{Q}'), '[a-z0-9][a-z0-9_.-]+')) as t), d as (select doc_id, concat('doc-', doc_id) as name, substr(text, 1, 80) as description, source as tags, text as body from documents)
, s as (select name, (3.0 * {HIT.format('name')} + 2.0 * {HIT.format('description')} + {HIT.format('body')}) / len(t) + case when contains(lower(name), '{Q}') then 3 when contains(lower(description), '{Q}') then 2 else 0 end + case when tags <> '' then {HIT.format('tags')} / len(t) else 0 end as score from d, q)"""


@query("X3", LEXICAL + f"""
, v as (select concat('doc-', a.vec_id) as name, round({DOT}, 6) as score from embeddings a, embeddings b where b.vec_id = 7)
select * from (select name, round(score, 6) as score, 'lexical-degraded' as search_mode from s where score > 0 order by s.score desc, lower(name) limit 9)
union all select v.*, 'semantic' from (select * from v order by score desc, name limit 9) v where name in (select name from d)""")
def search_mode(spark, sf):
    """One query with its vector and, as if the embedder had failed, without."""
    d = table(spark, sf, "documents").select(F.concat(F.lit("doc-"), "doc_id").alias("name"), F.substring("text", 1, 80).alias("description"), F.col("source").alias("tags"), F.col("text").alias("body"))
    e = table(spark, sf, "embeddings").select("vec_id", F.concat(F.lit("doc-"), "vec_id").alias("name"), F.col("embedding").alias("vector"))
    asked = e.where("vec_id = 7").first().vector
    both = search.search(d, e, Q, None, 9).unionByName(search.search(d, e, Q, asked, 9))
    return both.withColumn("score", F.round("score", 6))


ASKED = "select item_id as query_id, text as query from benchmark"
BM25 = f"""with asked as (select distinct query_id, unnest(regexp_extract_all(lower(query), '[a-z0-9]+')) as term from ({ASKED})), words as (select doc_id as id, regexp_extract_all(lower(text), '[a-z0-9]+') as w from documents)
, st as (select count(*) as n, avg(len(w)) as avgdl from words), tf as (select id, dl, term, count(*) as tf from (select id, len(w) as dl, unnest(w) as term from words) where term in (select term from asked) group by 1, 2, 3)
, df as (select term, count(*) as df from tf group by 1)
, sc as (select query_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) as score from tf join df using (term) join asked using (term), st group by 1, 2)
, bm as (select * from (select *, row_number() over (partition by query_id order by score desc, id) as rank from sc) where rank <= 10) """


def asked(spark, sf):
    """Each test item asks for the documents nearest to it."""
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def texts(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")


@query("X8 X18", BM25 + "select query_id, id, score, rank from bm")
def search_bm25(spark, sf):
    return search.bm25(texts(spark, sf), asked(spark, sf), 10)


@query("X6 X7 J13", BM25 + f""", vs as (select b.vec_id as query_id, a.vec_id as id, round({DOT}, 6) as score from embeddings a, embeddings b where b.vec_id in (select item_id from benchmark))
, v as (select * from (select *, row_number() over (partition by query_id order by score desc, id) as rank from vs) where rank <= 10)
, f as (select query_id, id, round(sum(1 / (60.0 + rank)), 9) as score from (select query_id, id, rank from bm union all select query_id, id, rank from v) group by 1, 2)
select * from (select *, row_number() over (partition by query_id order by score desc, id) as rank from f) where rank <= 10""")
def search_hybrid(spark, sf):
    """Test items as questions, each with the embedding of its number."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    q = e.withColumnRenamed("id", "query_id").join(search.few(asked(spark, sf)), "query_id", "right")
    return search.hybrid(texts(spark, sf), e, q, 10)


@query("A26", "select l_returnflag, l_linestatus, count(*) as n, grouping(l_returnflag) + grouping(l_linestatus) as level from lineitem group by rollup (l_returnflag, l_linestatus)")
def usage_rollup(spark, sf):
    g = table(spark, sf, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), (F.grouping("l_returnflag") + F.grouping("l_linestatus")).cast("int").alias("level"))
    return g.select("l_returnflag", "l_linestatus", "n", "level")


@query("P12 P27", "select doc_id, rtrim(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), '?!. ') as q, cast(length(text) // 4 as bigint) as tokens from documents")
def text_questions(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.normalized_question(F.col("text")).alias("q"), T.token_estimate(F.col("text")).alias("tokens"))


@query("P30", "select doc_id, case when length(t) > 500 then concat(left(t, 500), chr(10), '... <truncated ', length(t) - 500, ' chars>') else t end as text from (select doc_id, replace(replace(text, 'the', '<redacted>'), 'der', '<redacted>') as t from documents)")
def text_bounded(spark, sf):
    """What a log may say of each text: two words are secrets here."""
    return table(spark, sf, "documents").select("doc_id", T.bounded(F.col("text"), ("the", "der"), 500).alias("text"))


FAILURES = "select event_id, case event_id % 7 when 0 then 429 when 1 then 503 when 2 then 404 when 3 then 408 end as status, case event_id % 5 when 0 then 'RateLimitError' when 1 then 'ValueError' when 2 then 'APIConnectionError' else '' end as name, case event_id % 6 when 0 then 'Quota exceeded' when 1 then 'bad connection pool' when 2 then 'connection RESET by peer' when 3 then null else 'no such key' end as message from events"


@query("P25", f"""with f as ({FAILURES}) select event_id, case when status in (408, 429) or status >= 500 then true when status between 400 and 499 then false
else regexp_matches(lower(name), 'ratelimit|timeout|connection|internalserver|serviceunavailable') or coalesce(regexp_matches(lower(message), 'rate limit|rate-limit|quota|insufficient balance|model_cooldown|cooling down|timed out|timeout|connection reset|connection refused|connection error|provider unavailable|service unavailable|overloaded'), false) end as again from f""")
def text_transient_errors(spark, sf):
    f = spark.sql(FAILURES.replace("from events", "from {events}"), events=table(spark, sf, "events"))
    return f.select("event_id", T.transient_error(F.col("status"), F.col("name"), F.col("message")).alias("again"))
