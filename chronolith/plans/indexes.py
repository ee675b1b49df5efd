"""Queries over what is published by version: the text index and the page index."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from chronolith.operators import postings, reindex
from chronolith.operators.order import shared_dir
from chronolith.sources.published import Published

from . import knowledge
from .registry import query
from .workload import table


def new_store(spark, name):
    return Published(spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}")


def text_index(spark, sf):
    """An index that comes to hold all documents: the first segment has old texts of some, lacks others and has some more;
    the second one mends that."""
    docs, store = knowledge.texts(spark, sf), new_store(spark, "text-index")
    late, old = F.col("id") % 3 == 0, F.col("id") % 7 == 1
    first = docs.where(~late).withColumn("text", F.when(old, F.upper(F.substring("text", 1, 90))).otherwise(F.col("text")))
    extra = docs.where("id % 5 = 2").select((-1 - F.col("id")).alias("id"), "text")
    postings.ingest(store, first.unionByName(extra))
    postings.ingest(store, docs.where(late | old), extra)
    return store


@query("X8", knowledge.BM25 + "select query_id, id, score, rank from bm")
def search_index(spark, sf):
    """The questions of search_bm25 against a text index of two segments."""
    return postings.search(text_index(spark, sf), knowledge.asked(spark, sf), 10)


@query("X8", knowledge.BM25 + "select query_id, id, score, rank from bm")
def search_merged_index(spark, sf):
    """The same once its segments are merged."""
    store = text_index(spark, sf)
    postings.merge(store)
    return postings.search(store, knowledge.asked(spark, sf), 10)


@query("T6 S10 X3", """with d as (select * from documents), a as (select count(*) as n from d where doc_id % 10 <> 9), b as (select count(*) as n, count(*) filter (doc_id % 4 <> 0 and doc_id % 10 <> 9) as kept from d where doc_id % 10 <> 8)
select 1 as version, 'degraded' as status, 'RuntimeError' as error, n as pages, 0 as vectors from a union all select 2, 'ready', null, n, n from a
union all select 3, 'degraded', null, n, kept from b union all select 4, 'degraded', 'RuntimeError', n, kept from b union all select 5, 'degraded', null, n, kept from b union all select 6, 'ready', null, n, n from b""")
def pages_publication(spark, sf):
    """The versions that four builds of the page index leave, of which the first and the third cannot embed."""
    d = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("doc-"), "doc_id").alias("name"), F.coalesce("text", F.lit("")).alias("text"))
    hashed = lambda rows: rows.select("name", "text", F.sha2("text", 256).alias("embedding_hash"), F.sha2("text", 224).alias("body_hash"))
    before = hashed(d.where("doc_id % 10 <> 9"))
    after = hashed(d.where("doc_id % 10 <> 8").withColumn("text", F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit(" more"))).otherwise(F.col("text"))))
    store = new_store(spark, "page-index")

    def broken(rows):
        raise RuntimeError("no provider")

    def embed(rows):
        return rows.select("name", F.array(F.length("text").cast("double")).alias("vector"))

    for pages, how in ((before, broken), (before, embed), (after, broken), (after, embed)):
        reindex.reindex(store, pages, how)
    out = None
    for v in map(store.version, store.numbers()):
        one = store.table(v.tables[reindex.PAGES]).agg(F.lit(v.number).alias("version"), F.lit(v.status).alias("status"), F.lit(v.about["error"]).cast("string").alias("error"), F.count("*").alias("pages"), F.count("vector").alias("vectors"))
        out = one if out is None else out.unionByName(one)
    return out
