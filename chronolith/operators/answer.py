"""Questions answered from the graph: four kinds of evidence ranked, packed, distilled, grounded, cached and logged."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolith.functions import plugins
from chronolith.functions import text as T

from . import grounding, search
from .order import saved

K, FACTS_ONLY, SEMANTIC = 8, 5, 3
#: Each list of a kind is this many times as long as what is kept after fusion.
DEPTH = 2
NOTHING = "question_key string, watermark string, expires_at long, answer string, confidence string, sources array<string>"
SHOWN = {"name": "string", "text": "string", "source_slug": "string", "current": "boolean"}


def of_group(rows: DataFrame, group_id: str) -> DataFrame:
    return rows.where(F.col("group_id") == group_id)


def ranked_kind(kind: str, rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """rows(id, words, vector?, name?, text?, source_slug?, current?) by words, and by vector where the rows have that column
    -> hits(query_id, kind, rank, id, name, text, source_slug, current, score), k a query. Rows without a vector, and queries
    without one, are found by their words alone."""
    lists = [search.bm25(rows.select("id", F.coalesce("words", F.lit("")).alias("text")), queries.select("query_id", "query"), DEPTH * k)]
    if "vector" in rows.columns:
        asked = queries.where("vector is not null").select("query_id", F.col("vector").alias("query"))
        lists.append(search.vector_search(rows.where("vector is not null").select("id", "vector"), asked, DEPTH * k))
    best = saved(search.fuse(*lists, k=k))  # counted and joined: ranked once
    shown = [F.col(c).cast(t).alias(c) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in SHOWN.items()]
    return search.few(best).join(rows.select("id", *shown), "id").select("query_id", F.lit(kind).alias("kind"), "rank", F.col("id").cast("string").alias("id"), *SHOWN, "score")


def graph_search(kinds: dict[str, DataFrame], queries: DataFrame, k: int = K) -> DataFrame:
    """The k best of each kind for each of queries(query_id, query, vector): kinds maps fact, entity, episode and community to
    their rows in one group. Kinds are ranked by themselves; within a kind reciprocal ranks of its lists are added. Episodes
    have no vectors and are found by their words."""
    out = None
    for kind, rows in kinds.items():
        one = ranked_kind(kind, rows, queries, k)
        out = one if out is None else out.unionByName(one)
    return out


def facts_only(facts: DataFrame, queries: DataFrame, k: int = FACTS_ONLY) -> DataFrame:
    """The k best facts of each query, with their interval."""
    best = ranked_kind("fact", facts, queries, k).select("query_id", "rank", "id", "score")
    return best.join(facts.select(F.col("id").cast("string").alias("id"), F.col("text").alias("fact"), "valid_at", "invalid_at"), "id")


def with_semantic(hits: DataFrame, notes: DataFrame, queries: DataFrame, k: int = SEMANTIC) -> DataFrame:
    """The hits and, beside them, the k nearest of notes(name, description, vector)."""
    near = search.vector_search(notes.where("vector is not null").select(F.col("name").alias("id"), "vector"), queries.where("vector is not null").select("query_id", F.col("vector").alias("query")), k)
    told = search.few(saved(near)).join(notes.select(F.col("name").alias("id"), F.col("description").alias("text")), "id")
    return hits.unionByName(told.select("query_id", F.lit("semantic").alias("kind"), "rank", "id", F.col("id").alias("name"), "text", F.lit(None).cast("string").alias("source_slug"), F.lit(None).cast("boolean").alias("current"), "score"))


@dataclass
class Answers:
    """answers(query_id, question, answer, confidence, sources, superseded_note, escalate, cached, grounded, action), the cache
    as it is now, and one event for each question, as the use log takes them."""

    answers: DataFrame
    cache: DataFrame
    events: DataFrame


def watermark(episodes: DataFrame) -> str:
    """The version of the graph that answers are cached for: the last completion, or 'none'."""
    return str(episodes.agg(F.max("completed_at")).first()[0] or "none")


def answer(questions: DataFrame, kinds: dict[str, DataFrame], notes: DataFrame, version: str | None, now: Column, cache: DataFrame | None = None, distill: Callable[[DataFrame], DataFrame] = plugins.extractive_answer) -> Answers:
    """Answers questions(query_id, question, vector): what the cache has for this version of the graph is taken from it; for the
    rest a packet is put together, `distill` makes a candidate of it, and grounding keeps what the packet supports. Grounded
    answers are remembered. Questions that are the same but for case, blanks and end marks are one to the cache. A question
    whose packet holds nothing is not found; one for which the distiller returns nothing is an error, and neither is cached.
    A null question is an empty one; without a version (None) nothing is looked up or kept."""
    spark, none = questions.sparkSession, F.array().cast("array<string>")
    cache = cache if cache is not None else spark.createDataFrame([], NOTHING)
    asked = questions.select("query_id", F.trim(F.coalesce("question", F.lit(""))).alias("question"), "vector")
    known = saved(grounding.cached(asked, cache, version, now))
    hit = known.where("hit").select("query_id", "question", "answer", "confidence", "sources", F.lit(None).cast("string").alias("superseded_note"), F.lit(False).alias("escalate"), F.lit(True).alias("cached"), F.lit(True).alias("grounded"), F.lit("accepted").alias("action"), F.lit(0).cast("long").alias("packet_tokens"))
    missed = known.where("not hit").select("query_id", F.col("question").alias("query"), "vector")
    hits = with_semantic(graph_search(kinds, missed), notes, missed)
    packets = saved(search.packet(hits, K))
    allowed = grounding.allowed(packets)
    said = distill(packets).join(allowed, "query_id", "left")
    grounded = grounding.ground(said).select("query_id", "answer", "confidence", "sources", "superseded_note", "escalate", "grounded", "action")
    sized = packets.select("query_id", T.token_estimate(F.to_json(F.struct(*[c for c in packets.columns if c != "query_id"]))).cast("long").alias("packet_tokens"))
    # a question without any hit has an empty packet; one whose packet gave no candidate failed
    rest = missed.select("query_id", F.col("query").alias("question")).join(sized, "query_id", "left").join(grounded, "query_id", "left")
    found = F.col("action").isNotNull()
    empty = F.col("packet_tokens").isNull()
    fresh = rest.select(
        "query_id", "question", "answer", F.when(found, F.col("confidence")).when(empty, "not_found").otherwise("error").alias("confidence"), F.coalesce("sources", none).alias("sources"), "superseded_note",
        F.coalesce("escalate", F.lit(True)).alias("escalate"), F.lit(False).alias("cached"), F.coalesce("grounded", empty).alias("grounded"), F.when(found, F.col("action")).when(empty, "abstained").otherwise("error").alias("action"), F.coalesce("packet_tokens", F.lit(0)).alias("packet_tokens"),
    )
    done = saved(hit.unionByName(fresh))
    kept = saved(grounding.remember(cache, done.where("not cached"), version, now))
    events = done.select(
        now.alias("ts"), F.lit("graph_answer").alias("tool"), F.substring("question", 1, 200).alias("question"), "confidence", F.size("sources").alias("n_sources"), "escalate",
        T.token_estimate(F.coalesce("answer", F.lit(""))).alias("answer_tokens"), "packet_tokens", "cached", "grounded", F.col("action").alias("grounding_action"),
    )
    return Answers(done.drop("packet_tokens"), kept, events)
