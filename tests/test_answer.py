"""Direct answers: hits, misses, errors, questions without anything, and what is logged."""

from pyspark.sql import functions as F

from chronolith.operators import answer

ROW = "id long, words string, name string, text string, source_slug string, current boolean"


def kinds(spark):
    facts = [(1, "the cache runs on valkey", "cache", "cache runs on valkey", "n1", True), (2, "the cache ran on memcached", "cache", "cache ran on memcached", "n0", False), (3, "backups go to tape", "backups", "backups go to tape", "", True)]
    rest = lambda rows: spark.createDataFrame(rows, ROW)
    return {"fact": rest(facts).withColumn("vector", F.lit(None).cast("array<double>")), "entity": rest([(7, "valkey", "Valkey", "a cache", None, None)]), "episode": rest([(8, "cache moved", "n1", "moved the cache", None, None)]), "community": rest([]), }


def ask(spark, rows, version="v1", at=1000, cache=None, **more):
    said = spark.createDataFrame(rows, "query_id long, question string").withColumn("vector", F.lit(None).cast("array<double>"))
    notes = spark.createDataFrame([], "name string, description string, vector array<double>")
    return answer.answer(said, kinds(spark), notes, version, F.lit(at).cast("long"), cache, **more)


def by_id(df):
    return {r.query_id: (r.answer, r.confidence, r.cached, r.grounded, r.action) for r in df.collect()}


QUESTIONS = [(1, "Where does the cache run?"), (2, "tape"), (3, "nothing known"), (4, None), (5, "memcached")]


def test_answers_are_grounded_cached_and_logged(spark):
    first = ask(spark, QUESTIONS)
    got = by_id(first.answers)
    assert got[1] == ("cache runs on valkey", "medium", False, True, "accepted")
    assert got[2][4] == "rejected" and got[2][0] is None  # its fact has no source
    assert got[3] == got[4] == (None, "not_found", False, True, "abstained")
    assert {r.question_key for r in first.cache.collect()} == {"where does the cache run"}
    events = {r.question: r for r in first.events.collect()}
    assert len(events) == 5 and events["Where does the cache run?"].packet_tokens > 20 and events[""].packet_tokens == 0 and not events["tape"].cached
    second = ask(spark, [(9, " where DOES the cache run ?! "), (2, "tape")], at=2000, cache=first.cache)
    assert by_id(second.answers)[9] == ("cache runs on valkey", "medium", True, True, "accepted") and not by_id(second.answers)[2][2]
    for late in (ask(spark, QUESTIONS[:1], at=9000, cache=first.cache), ask(spark, QUESTIONS[:1], version="v2", cache=first.cache)):
        assert not by_id(late.answers)[1][2]
    unversioned = ask(spark, QUESTIONS[:1], version=None, cache=first.cache)
    assert not by_id(unversioned.answers)[1][2] and unversioned.cache.count() == 0


def test_a_distiller_that_fails_or_invents(spark):
    silent = ask(spark, QUESTIONS[:1], distill=lambda packets: packets.select("query_id", *[F.lit(None).cast("string").alias(c) for c in ("confidence", "answer", "superseded_note")], F.array().cast("array<string>").alias("sources"), F.lit(False).alias("escalate")).limit(0))
    assert by_id(silent.answers)[1] == (None, "error", False, False, "error") and silent.cache.count() == 0

    def invents(packets):
        return packets.select("query_id", F.lit("high").alias("confidence"), F.lit("on redis").alias("answer"), F.array(F.lit("n9"), F.lit("n0")).alias("sources"), F.lit("none").alias("superseded_note"), F.lit(False).alias("escalate"))

    got = by_id(ask(spark, [(1, "cache")], distill=invents).answers)
    assert got[1] == ("on redis", "medium", False, True, "downgraded")


def test_watermark(spark):
    assert answer.watermark(spark.createDataFrame([("2024-01-02",), (None,), ("2024-03-01",)], "completed_at string")) == "2024-03-01"
    assert answer.watermark(spark.createDataFrame([], "completed_at string")) == "none"


def test_kinds_without_vectors_and_without_rows(spark):
    asked = spark.createDataFrame([(1, "cache", None)], "query_id long, query string, vector array<double>")
    hits = answer.graph_search(kinds(spark), asked, 2).collect()
    assert {(r.kind, r.id) for r in hits} == {("fact", "1"), ("fact", "2"), ("episode", "8")}
    only = answer.facts_only(kinds(spark)["fact"].withColumns({"valid_at": F.lit("a"), "invalid_at": F.lit(None)}), asked, 1).collect()
    assert [(r.id, r.fact) for r in only] == [("1", "cache runs on valkey")] or [(r.id) for r in only] == ["2"]


def test_a_kind_is_ranked_once(spark, monkeypatch):
    made, ranked = answer.saved, []
    monkeypatch.setattr(answer, "saved", lambda df: (ranked.append(df.columns), made(df))[1])
    asked = spark.createDataFrame([(1, "cache", None)], "query_id long, query string, vector array<double>")
    hits = answer.graph_search(kinds(spark), asked, 2)
    assert len(ranked) == 4 and "MapInArrow" not in hits._jdf.queryExecution().optimizedPlan().toString()
