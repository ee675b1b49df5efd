"""Ranked retrieval: vectors, lexical fallback, BM25, reciprocal rank fusion and evidence packets.

Queries are DataFrames as well, so that a batch of questions is one job: every ranking is within query_id."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scoring
from .order import saved
from .scoring import K1, B

RRF_K = 60
CAPS = {"fact": 12, "entity": 8, "community": 3, "episode": 2, "semantic": 3}


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, v: s + v)


def unit(v: Column) -> Column:
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(norm > 0, x / norm).otherwise(F.lit(0.0)))


def top_k(scored: DataFrame, k: int, *ties: str) -> DataFrame:
    """Within query_id the k best by score, ties by name; adds rank."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), *ties)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def few(df: DataFrame, most: int = 200_000) -> DataFrame:
    """Broadcast if there are at most `most` rows, as counted; else joined as it comes."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def vector_search(vectors: DataFrame, queries: DataFrame, k: int, digits: int = 6, block: int = 10_000) -> DataFrame:
    """vectors(id, vector), queries(query_id, query) -> the k nearest of each query by inner product: the stated query
    set against all rows. It costs rows times queries; queries go to the tasks in blocks of about `block`, each of which
    is one pass over the rows that multiplies matrices and keeps k a query and task before the shuffle. Vectors of another
    size than the queries', with nulls, or too large for sums to be rounded exactly, are multiplied one by one."""
    dim, out = queries.agg(F.max(F.size("query"))).first()[0] or 0, None
    far = (4e9 / max(dim, 1)) ** 0.5
    plain = lambda c: F.coalesce((F.size(c) == dim) & ~F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) > far)), F.lit(False))
    one = lambda v, q: v.join(F.broadcast(q), F.lit(True)).select("query_id", "id", dot(F.col("vector"), F.col("query")).alias("score"))
    for some in scoring.blocks(queries, block):
        scores = one(vectors.where(~plain("vector")), some).unionByName(one(vectors.where(plain("vector")), some.where(~plain("query"))))
        if dim:
            scores = scores.unionByName(scoring.nearest(vectors.where(plain("vector")), some.where(plain("query")), dim, k, digits))
        near = top_k(scores.withColumn("score", F.round("score", digits)), k, "id")
        out = near if out is None else out.unionByName(near)
    return out if out is not None else none_ranked(queries, vectors)


def none_ranked(queries: DataFrame, rows: DataFrame) -> DataFrame:
    return rows.sparkSession.createDataFrame([], scoring.schema(queries, rows)).withColumn("rank", F.lit(0))


def search(pages: DataFrame, vectors: DataFrame, query: str, embedded: list[float] | None, k: int) -> DataFrame:
    """The k best pages(name, description, tags, body) for a query -> (name, score, search_mode): by inner product with
    vectors(name, vector) where the query could be embedded, else (None: the embedder failed) by words, as degraded."""
    if embedded is None:
        return lexical_search(pages, query, k).select("name", "score", F.lit("lexical-degraded").alias("search_mode"))
    asked = F.array(*[F.lit(float(x)) for x in embedded])
    near = vectors.select("name", F.round(dot(F.col("vector"), asked), 6).alias("score")).orderBy(F.desc("score"), "name").limit(k)
    return near.join(pages.select("name"), "name", "left_semi").select("name", "score", F.lit("semantic").alias("search_mode"))


def query_tokens(q: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(q), F.lit(r"([a-z0-9][a-z0-9_.-]+)"), F.lit(1)))


def lexical_score(query: Column, name: Column, description: Column, tags: Column, body: Column) -> Column:
    """Substring hits: 3 for each token in the name, 2 in the description, 1 in the body, over the number of tokens;
    3 for the whole phrase in the name, else 2 in the description; and the share of tokens in the tags."""
    tokens, phrase = query_tokens(query), F.trim(F.lower(query))
    n = F.greatest(F.size(tokens), F.lit(1))
    hits = lambda c: F.size(F.filter(tokens, lambda t: F.contains(F.lower(c), t)))
    bonus = F.when((phrase != "") & F.contains(F.lower(name), phrase), 3.0).when((phrase != "") & F.contains(F.lower(description), phrase), 2.0).otherwise(0.0)
    tag = F.when(F.coalesce(tags, F.lit("")) != "", hits(tags) / n).otherwise(0.0)
    return F.when(F.size(tokens) > 0, (3.0 * hits(name) + 2.0 * hits(description) + hits(body)) / n + bonus + tag).otherwise(0.0)


def lexical_search(pages: DataFrame, query: str, k: int) -> DataFrame:
    scored = pages.withColumn("score", lexical_score(F.lit(query), F.col("name"), F.col("description"), F.col("tags"), F.col("body"))).where("score > 0")
    return scored.orderBy(F.desc("score"), F.lower("name")).limit(k)


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9]+)"), F.lit(1))


def bm25(docs: DataFrame, queries: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """docs(id, text), queries(query_id, query) -> the k best of each query (Robertson & Zaragoza 2009). Queries go to the
    tasks in blocks of about scoring.ASKED. For each one pass over the texts counts the asked terms of each document; this
    slim table is written once, and gives the statistics as well as the scores, which are products of matrices."""
    out = None
    for some in scoring.blocks(queries, scoring.ASKED):
        of = scoring.Question(some.select("query_id", F.explode(F.array_distinct(terms(F.col("query")))).alias("term")))
        tf = saved(scoring.counted(docs.select("id", terms(F.col("text")).alias("words")).where("words is not null"), of))
        stats = tf.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).first()
        df = np.zeros(len(of.terms))
        for r in tf.select(F.explode("term").alias("term")).groupBy("term").count().collect():  # a row a term of the block
            df[r.term] = r["count"]
        idf = np.log(1 + (stats.n - df + 0.5) / (df + 0.5))
        scored = scoring.ranked(tf, of, some, idf, stats.avgdl or 1.0, k, digits)
        best = top_k(scored.withColumn("score", F.round("score", digits)), k, "id")
        out = best if out is None else out.unionByName(best)
    return out if out is not None else none_ranked(queries, docs)


def fuse(*ranked: DataFrame, k: int, k0: int = RRF_K, digits: int = 9) -> DataFrame:
    """Reciprocal rank fusion (Cormack et al. 2009) of lists (query_id, id, rank): union and one aggregation."""
    rows = ranked[0].select("query_id", "id", "rank")
    for r in ranked[1:]:
        rows = rows.unionByName(r.select("query_id", "id", "rank"))
    return top_k(rows.groupBy("query_id", "id").agg(F.round(F.sum(1 / (k0 + F.col("rank"))), digits).alias("score")), k, "id")


def hybrid(docs: DataFrame, vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """BM25 over docs(id, text) fused with vectors(id, vector) for queries(query_id, query, vector)."""
    words = bm25(docs, queries.select("query_id", "query"), k)
    near = vector_search(vectors, queries.where("vector is not null").select("query_id", F.col("vector").alias("query")), k)
    return fuse(words, near, k=k)


def capped(hits: DataFrame, k: int) -> DataFrame:
    """hits(query_id, kind, rank, …) within each kind's cap; all but semantic hits within k as well."""
    cap = F.create_map(*[x for kind, n in CAPS.items() for x in (F.lit(kind), F.lit(n))])[F.col("kind")]
    w = Window.partitionBy("query_id", "kind").orderBy("rank")
    ranked = hits.withColumn("place", F.row_number().over(w))
    return ranked.where((F.col("place") <= cap) & ((F.col("kind") == "semantic") | (F.col("place") <= k)))


def packet(hits: DataFrame, k: int) -> DataFrame:
    """hits(query_id, kind, rank, name, text, source_slug, current, score) -> one row for each query with nested facts,
    communities, entities, semantic_notes and source_excerpt."""
    rows = capped(hits, k)

    def part(kind: str, **fields: Column) -> Column:
        named = F.struct("place", *[v.alias(n) for n, v in fields.items()])
        return F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, named))), lambda s: F.struct(*[s[n].alias(n) for n in fields]))

    text, name = F.col("text"), F.col("name")
    episodes = part("episode", slug=name, content=F.substring(text, 1, 2500))
    return rows.groupBy("query_id").agg(
        part("fact", fact=text, source_slug=F.col("source_slug"), current=F.col("current")).alias("facts"),
        part("community", name=F.substring(name, 1, 120), summary=F.substring(text, 1, 1000)).alias("communities"),
        part("entity", name=name, summary=F.substring(text, 1, 300)).alias("entities"),
        part("semantic", name=name, score=F.bround("score", 3), description=F.substring(text, 1, 200)).alias("semantic_notes"),
        F.try_element_at(episodes, F.lit(1)).alias("source_excerpt"),
    )
