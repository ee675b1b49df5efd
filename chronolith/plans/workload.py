"""Derived views over the driver's tables, each written once in SQL that Spark and DuckDB both read.

{name} stands for a table or another view; sha256(x) becomes sha2(x, 256) for Spark."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "facts": """
select o_orderkey as uuid, o_custkey as subject, o_orderpriority as object, concat('customer ', o_custkey, ' prefers ', o_orderpriority) as fact,
  concat('c', o_custkey) as src, o_orderpriority as dst, concat('Customer ', o_custkey) as subject_name, o_orderpriority as object_name, o_orderdate as valid_at,
  lead(o_orderdate) over (partition by o_custkey order by o_orderdate, o_orderkey) as invalid_at
from {orders}""",
    "entities": """
select concat('c', c_custkey) as uuid, c_name as name, c_mktsegment as summary from {customer}
union all select concat('s', s_suppkey), s_name, 'supplier' from {supplier}
union all select concat('p', p_partkey), concat(p_name, case when p_partkey % 5 = 0 then ' cluster' when p_partkey % 5 = 1 then ' Service' else '' end), p_type from {part}""",
    "query_log": """
select event_id, user_id, ts, case event_type when 'click' then 'wiki_search' when 'view' then 'wiki_get' when 'purchase' then 'graph_answer' when 'signup' then 'graph_search' else 'other_tool' end as tool,
  value as duration_ms, value / 200.0 as score, cast(event_id % 4 as int) as n, user_id % 10 = 0 as test, event_id % 3 = 0 as cached,
  case when event_type = 'purchase' then case event_id % 5 when 0 then 'high' when 1 then 'medium' when 2 then 'low' when 3 then 'not_found' else 'error' end end as confidence,
  case when event_id % 11 = 0 then 'degraded' when event_id % 13 = 0 then 'error' else 'ok' end as outcome, case when event_id % 17 = 0 then 'Boom' else '' end as error,
  concat('What  is item ', user_id % 97, case when event_id % 2 = 0 then ' ? ' else '' end) as query, event_id % 300 as answer_tokens, event_id % 2000 as packet_tokens
from {events}""",
    "pages": """
select doc_id, concat('doc-', doc_id) as name,
  concat(case when doc_id % 29 = 0 then '' else concat('---', chr(10), case when doc_id % 13 = 0 then '' else concat('type: ', case doc_id % 7 when 0 then 'entity' when 1 then 'concept' when 2 then 'source' when 3 then 'synthesis' when 4 then 'decision' when 5 then 'log' else 'memo' end, chr(10)) end,
    case when doc_id % 3 = 0 then concat('category: cat', doc_id % 4, chr(10)) else '' end, case when doc_id % 4 = 0 then concat('status: ', case doc_id % 3 when 0 then 'live' when 1 then 'superseded' else 'odd' end, chr(10)) else '' end,
    'created: ', case when doc_id % 19 = 0 then 'someday' else concat('2024-0', 1 + doc_id % 9, '-1', doc_id % 10) end, chr(10), case when doc_id % 31 = 0 then concat('updated: 24-1-1', chr(10)) else '' end, case when doc_id % 8 = 0 then concat('superseded-by: doc-', doc_id, chr(10)) else '' end,
    case doc_id % 6 when 1 then concat('sources: ["[[doc-', doc_id % 100, ']]", "[[gone ', doc_id % 3, ']]"]', chr(10)) when 2 then concat('sources: doc-1', chr(10)) else '' end, case when doc_id % 5 = 0 then concat('length-exempt: yes', chr(10)) else '' end,
    'tags: [', source, case when doc_id % 6 = 0 then ', Big Tag' else '' end, ']', chr(10), '---', chr(10)) end, '# doc-', case when doc_id % 17 = 0 then 'x' else '' end, doc_id, chr(10), chr(10), text, chr(10), chr(10),
    case when doc_id % 10 in (1, 7) then repeat(concat('- a line', chr(10)), 260) else '' end, 'See [[doc-', doc_id * 7 % 150, '|alias]] and [[', case when doc_id % 2 = 0 then 'Doc-' else 'doc-' end, doc_id * 3 % 150, '#part]]',
    case when doc_id % 5 = 0 then concat(' or [[nowhere ', doc_id % 10, ']]') else '' end, ' but not `[[code]]`.', chr(10)) as content,
  case when doc_id % 7 = 2 then concat('wiki/sources/notes/2024/0', 1 + doc_id % 9, '/1', doc_id % 10, '/doc-', doc_id, '/doc-', doc_id, '.md') when doc_id % 37 = 0 then concat('wiki/log/2024-W', 10 + doc_id % 40, '/doc-', doc_id, '.md') else concat('wiki/doc-', doc_id, '.md') end as path
from {documents}""",
    "notes": """
select doc_id, concat('2024-01-', lpad(cast(1 + doc_id % 28 as varchar(4)), 2, '0'), '-', lpad(cast(doc_id % 24 as varchar(4)), 2, '0'), '3000-doc-', doc_id) as slug, text as body from {documents}""",
    "episodes": """
select concat('2024-01-', lpad(cast(1 + doc_id % 28 as varchar(4)), 2, '0'), '-', lpad(cast(doc_id % 24 as varchar(4)), 2, '0'), '3000-doc-', doc_id) as slug, concat('e', doc_id, '-', k) as uuid,
  case when (doc_id + k) % 3 = 0 then null else (doc_id + k) % 3 = 1 end as complete,
  case when doc_id % 4 = 0 then null when doc_id % 4 = 1 then sha256(text) when doc_id % 4 = 2 then 'old' else sha256(concat(text, case when k = 1 then '' else '!' end)) end as content_hash,
  case when doc_id % 2 = 0 then text end as content, cast((doc_id + k) % 2 as bigint) as mention_count, concat('2024-02-0', k) as created_at, case when doc_id % 9 = 0 then null else concat('2024-03-1', doc_id % 10) end as completed_at
from {documents} cross join (select 1 as k union all select 2) where doc_id % 5 <> 0""",
    "queue": """
select case o_orderstatus when 'F' then 'inbox' when 'O' then 'deferred' else 'curated' end as queue, concat('note-', o_orderkey) as slug, o_orderdate as ts from {orders}""",
    "log_lines": """
select cast(o_custkey % 50 as bigint) as file, o_orderkey as line_no, case when o_orderkey % 7 = 0 then concat('## [1999-01-01] ', case o_orderkey % 3 when 0 then 'ingest | x' when 1 then 'note | y' else 'auto-ingest | z' end)
  else concat('- done note-', o_orderkey % 400, case when o_orderkey % 5 = 0 then '-extra' else '' end, ' ok') end as line from {orders}""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = re.sub(r"sha256\((text|concat\(.*?end\))\)", r"sha2(\1, 256)", VIEWS[name])
    used = {n: view(spark, sf_dir, n) if n in VIEWS else table(spark, sf_dir, n) for n in re.findall(r"\{(\w+)\}", sql)}
    return spark.sql(sql, **used)


def cte(*names: str) -> str:
    return "with " + ", ".join(f"{n} as ({re.sub(r'[{}]', '', VIEWS[n])})" for n in names) + " "
