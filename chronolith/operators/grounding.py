"""Deterministic grounding of candidate answers in the evidence they were given."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolith.functions import text as T

ACTIONS = ("accepted", "filtered", "downgraded", "rejected", "abstained", "error")
MOST_SOURCES = 5
CACHE_SECONDS, CACHE_MAX = 3600, 500


def strengths(packet: DataFrame) -> DataFrame:
    """packet(query_id, facts, source_excerpt, semantic_notes) -> (query_id, slug, strong): current facts and the
    excerpt support strongly, superseded facts and semantic hits weakly; the strongest counts."""
    fact = packet.select("query_id", F.explode("facts").alias("f")).select("query_id", F.trim("f.source_slug").alias("slug"), F.coalesce("f.current", F.lit(True)).alias("strong"))
    excerpt = packet.select("query_id", F.trim("source_excerpt.slug").alias("slug"), F.lit(True).alias("strong"))
    note = packet.select("query_id", F.explode("semantic_notes").alias("s")).select("query_id", F.trim("s.name").alias("slug"), F.lit(False).alias("strong"))
    return fact.unionByName(excerpt).unionByName(note).where("slug <> ''").groupBy("query_id", "slug").agg(F.bool_or("strong").alias("strong"))


def allowed(packet: DataFrame) -> DataFrame:
    """(query_id, strong array, weak array) of slugs."""
    rows = strengths(packet)
    pick = lambda on: F.sort_array(F.collect_list(F.when(on, F.col("slug"))))
    return rows.groupBy("query_id").agg(pick(F.col("strong")).alias("strong"), pick(~F.col("strong")).alias("weak"))


def clean_sources(raw: Column) -> Column:
    return F.filter(F.transform(F.coalesce(raw, F.array().cast("array<string>")), lambda s: F.trim(F.coalesce(s, F.lit("")))), lambda s: s != "")


def ground(candidates: DataFrame) -> DataFrame:
    """candidates(confidence, answer, sources, superseded_note, escalate, strong, weak) -> adds grounded, action and the
    final answer, confidence, sources, superseded_note, escalate.

    An unknown confidence is low; no answer or not_found abstains; only evidence's slugs stay, in order, five at most;
    none left rejects; an invented one before the fifth filters; high without strong support becomes medium."""
    none = F.array().cast("array<string>")
    conf = F.lower(F.trim(F.coalesce("confidence", F.lit("low"))))
    rows = candidates.withColumns({
        "conf": F.when(conf.isin("high", "medium", "low", "not_found"), conf).otherwise("low"),
        "said": F.when(~F.coalesce("answer", F.lit("")).isin("", "null"), F.substring("answer", 1, 2000)),
        "raw": clean_sources(F.col("sources")),
        "known": F.concat(F.coalesce("strong", none), F.coalesce("weak", none)),
    })
    # the fifth distinct allowed source ends the list: what is invented behind it does not count
    rows = rows.withColumn("kept", F.slice(F.array_distinct(F.filter("raw", lambda s: F.array_contains(F.col("known"), s))), 1, MOST_SOURCES))
    until = F.when(F.size("kept") >= MOST_SOURCES, F.array_position("raw", F.element_at("kept", MOST_SOURCES))).otherwise(F.size("raw"))
    rows = rows.withColumn("invented", F.exists(F.slice("raw", F.lit(1), until.cast("int")), lambda s: ~F.array_contains(F.col("known"), s)))
    abstains = (F.col("conf") == "not_found") | F.col("said").isNull()
    rejects, weak = F.size("kept") == 0, (F.col("conf") == "high") & ~F.arrays_overlap("kept", F.coalesce("strong", none))
    action = F.when(abstains, "abstained").when(rejects, "rejected").when(weak, "downgraded").when(F.col("invented"), "filtered").otherwise("accepted")
    note = F.when(~F.lower(F.trim(F.coalesce("superseded_note", F.lit("none")))).isin("none", "null", "n/a", ""), F.substring("superseded_note", 1, 500))
    ok = ~abstains & ~rejects
    return rows.withColumns({
        "grounded": abstains | ~rejects, "action": action, "answer": F.when(ok, F.col("said")), "sources": F.when(ok, F.col("kept")).otherwise(none),
        "confidence": F.when(~ok, "not_found").when(weak, "medium").otherwise(F.col("conf")), "superseded_note": F.when(ok, note),
        "escalate": F.when(~ok, True).otherwise(F.coalesce("escalate", F.lit(False))),
    }).drop("conf", "said", "raw", "known", "kept", "invented")


def action_counts(grounded: DataFrame) -> DataFrame:
    """(action, n) with every action, zero where it never occurred."""
    all_ = grounded.sparkSession.createDataFrame([(a,) for a in ACTIONS], "action string")
    seen = grounded.groupBy(F.when(F.col("action").isin(*ACTIONS), F.col("action")).otherwise("error").alias("action")).count()
    return F.broadcast(all_).join(seen, "action", "left").select("action", F.coalesce("count", F.lit(0)).alias("n"))


def cached(questions: DataFrame, cache: DataFrame, watermark: str | None, now: Column) -> DataFrame:
    """questions(question, …) against cache(question_key, watermark, expires_at, answer, confidence, sources) -> adds hit
    and the cached answer. Keys are normalised questions; entries of another watermark or past their time do not count, and
    without a watermark nothing is looked up."""
    usable = cache.where((F.col("watermark") == F.lit(watermark)) & (F.col("expires_at") > now)).select("question_key", "answer", "confidence", "sources", F.lit(True).alias("found"))
    keyed = questions.withColumn("question_key", T.normalized_question(F.col("question")))
    return keyed.join(usable, "question_key", "left").withColumn("hit", F.coalesce("found", F.lit(False))).drop("found")


def remember(cache: DataFrame, grounded: DataFrame, watermark: str | None, now: Column, most: int = CACHE_MAX, seconds: int = CACHE_SECONDS) -> DataFrame:
    """The cache with the answers of grounded(question, answer, confidence, sources, grounded): only grounded ones that
    say something are kept. A changed watermark empties it, a question's new answer replaces its old one, and of more than
    `most` entries those that expire first go."""
    keep = F.col("grounded") & (F.coalesce("answer", F.lit("")) != "") & F.col("confidence").isin("high", "medium", "low") & F.lit(watermark is not None)
    new = grounded.where(keep).select(T.normalized_question(F.col("question")).alias("question_key"), F.lit(watermark).cast("string").alias("watermark"), (now + F.lit(seconds)).alias("expires_at"), "answer", "confidence", "sources")
    rows = cache.where(F.col("watermark") == F.lit(watermark)).unionByName(new)
    last = rows.groupBy("question_key").agg(F.max_by(F.struct(*rows.columns), F.struct("expires_at", "answer")).alias("r")).select("r.*")
    return last.orderBy(F.desc("expires_at"), "question_key").limit(most)
