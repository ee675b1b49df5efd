"""Versions: readers keep theirs, failed builds change nothing, deltas of the text index are seen."""

import glob
import os
import random
import re
from collections import Counter
from math import log

import pytest
from pyspark.sql import functions as F

from chronolith.operators import postings, reindex
from chronolith.sources.published import DEGRADED, READY, Published


@pytest.fixture
def store(spark, tmp_path):
    return Published(spark, str(tmp_path / "store"))


def plain_bm25(docs, queries, k):
    words = {i: re.findall("[a-z0-9]+", (t or "").lower()) for i, t in docs.items()}
    n, mean = len(docs), sum(map(len, words.values())) / max(1, len(docs))
    tf = {i: Counter(w) for i, w in words.items()}
    df = Counter(t for c in tf.values() for t in c)
    out = {}
    for q, text in queries.items():
        asked = set(re.findall("[a-z0-9]+", text.lower()))
        scores = {i: sum(log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * len(words[i]) / mean)) for t in asked if c[t]) for i, c in tf.items() if asked & c.keys()}
        best = sorted(((round(s, 6), -i) for i, s in scores.items()), reverse=True)[:k]
        out.update({(q, r): (-i, pytest.approx(s, abs=2e-6)) for r, (s, i) in enumerate(best, 1)})
    return out


def found(df):
    return {(r.query_id, r["rank"]): (r.id, r.score) for r in df.collect()}


def test_segments_removals_and_merges_score_as_all_texts(spark, store, monkeypatch):
    monkeypatch.setattr(postings, "SLOT", 8)
    monkeypatch.setattr(postings, "FIRST", 2)
    rng = random.Random(2)
    words = [f"w{int(rng.paretovariate(0.7)) % 60}" for _ in range(4000)]
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(1, 40)))
    docs = {i: text() for i in range(300)}
    queries = {q: " ".join({rng.choice(words) for _ in range(rng.randrange(1, 5))}) for q in range(25)} | {90: "unknown", 91: ""}
    asked = spark.createDataFrame(list(queries.items()), "query_id long, query string")
    table = lambda d: spark.createDataFrame(list(d.items()), "id long, text string")
    postings.ingest(store, table(docs).unionByName(spark.createDataFrame([(None, "w1 w1")], "id long, text string")))
    first = store.latest()
    assert found(postings.search(store, asked, 5)) == plain_bm25(docs, queries, 5)
    new = {i: text() for i in range(250, 330)} | {7: None, 8: ""}
    gone = [1, 2, 3, 260, 999]
    postings.ingest(store, table(new), spark.createDataFrame([(g,) for g in gone], "id long"))
    # a document both added and removed is added
    now = {i: t for i, t in docs.items() if i not in gone} | new
    assert found(postings.search(store, asked, 5)) == plain_bm25(now, queries, 5)
    assert found(postings.search(store, asked, 5, version=first)) == plain_bm25(docs, queries, 5)
    postings.ingest(store, table({260: "w1 w2 w2", 5: "w3"}), spark.createDataFrame([(250,)], "id long"))
    now = {i: t for i, t in now.items() if i != 250} | {260: "w1 w2 w2", 5: "w3"}
    want = plain_bm25(now, queries, 5)
    assert found(postings.search(store, asked, 5)) == want
    postings.merge(store)
    assert len([t for t in store.latest().tables if t.endswith("postings")]) == 1
    assert found(postings.search(store, asked, 5)) == want
    assert store.vacuum(keep=1) > 4 and found(postings.search(store, asked, 5)) == want
    monkeypatch.setattr(postings, "few", lambda df: df)
    assert found(postings.search(store, asked, 5)) == want


def test_a_search_opens_its_terms_folders_only(spark, store):
    docs = spark.range(400).select("id", F.concat_ws(" ", *[F.concat(F.lit(f"t{k}x"), F.col("id") % (7 + k)) for k in range(12)]).alias("text"))
    postings.ingest(store, docs)
    path = next(p for t, p in store.latest().tables.items() if t.endswith("postings"))
    folders = len(glob.glob(f"{store.path}/{path}/folder=*"))
    asked = spark.createDataFrame([(1, "t3x4")], "query_id long, query string")
    want = found(postings.search(store, asked, 3))
    h = spark.sql("select xxhash64('t3x4')").first()[0]
    for f in glob.glob(f"{store.path}/{path}/folder=*"):
        if not f.endswith(f"folder={(h % 2**64) >> 58}"):
            for part in glob.glob(f"{f}/*"):
                os.truncate(part, 0)  # whoever opens it fails
    assert folders > 30 and found(postings.search(store, asked, 3)) == want and [want[1, r][0] for r in (1, 2, 3)] == [4, 14, 24]


def test_readers_keep_their_version_and_one_of_two_writers_fails(spark, store):
    one = store.commit({"t": store.write(spark.range(3), "t")})
    reader = store.table(one.tables["t"])
    two = store.commit({"t": store.write(spark.range(5), "t")}, after=one)
    with pytest.raises(ValueError):
        store.commit({"t": "data/other"}, after=one)
    assert reader.count() == 3 and store.table(store.latest().tables["t"]).count() == 5 and store.latest() == two
    store.write(spark.range(9), "t")  # never committed
    assert store.vacuum(keep=1) == 2 and store.numbers() == [2] and store.table(two.tables["t"]).count() == 5


PAGE = "name string, text string, embedding_hash string, body_hash string"


def pages(spark, rows):
    return spark.createDataFrame([(n, t, f"h-{t}", f"b-{t}") for n, t in rows], PAGE)


def embedded(rows):
    return rows.select("name", F.array(F.length("text").cast("double")).alias("vector"))


def vectors(store):
    return {r.name: r.vector for r in store.table(store.latest().tables["pages"]).collect()}


def test_reindex_serves_the_known_part_while_and_after_a_build_fails(spark, store):
    seen = []

    def watched(rows):
        seen.append((store.latest().status if store.latest() else None, vectors(store) if store.latest() else None, sorted(r.name for r in rows.collect())))
        return embedded(rows)

    def broken(rows):
        watched(rows)
        raise TimeoutError("provider")

    assert reindex.reindex(store, pages(spark, []), watched)["error"] == "NoPages" and store.latest() is None
    assert reindex.reindex(store, pages(spark, [("a", "x"), ("b", "yy")]), broken) | {"version": 0} == {"ok": False, "retry_needed": True, "embedded": 0, "omitted": 2, "error": "TimeoutError", "version": 0, "pages": 2, "unchanged": 0, "legacy_migrated": 0, "removed": 0}
    assert seen[-1][0] is None and store.latest().status == DEGRADED and vectors(store) == {"a": None, "b": None}
    assert reindex.reindex(store, pages(spark, [("a", "x"), ("b", "yy")]), watched)["ok"] and store.latest().status == READY
    whole = store.latest()
    reader = store.table(whole.tables["pages"])
    report = reindex.reindex(store, pages(spark, [("a", "x"), ("c", "zzz")]), broken)
    assert (report["unchanged"], report["omitted"], report["removed"], report["ok"]) == (1, 1, 1, False)
    assert seen[-1] == (DEGRADED, {"a": [1.0], "c": None}, ["c"])  # readable during the build
    assert store.latest().about["error"] == "TimeoutError" and vectors(store) == {"a": [1.0], "c": None}
    assert {r.name for r in reader.collect()} == {"a", "b"}
    short = reindex.reindex(store, pages(spark, [("a", "x"), ("c", "zzz"), ("d", "w")]), lambda rows: embedded(rows.where("name = 'c'")))
    assert short["error"] == "ValueError" and store.latest().status == DEGRADED
    done = reindex.reindex(store, pages(spark, [("a", "x"), ("c", "zzz")]), watched)
    assert done["embedded"] == 1 and vectors(store) == {"a": [1.0], "c": [3.0]} and store.latest().status == READY
    again = reindex.reindex(store, pages(spark, [("a", "x"), ("c", "zzz")]), broken)
    assert again["ok"] and again["unchanged"] == 2


def test_legacy_hashes_count_once(spark, store):
    old = pages(spark, [("a", "x"), ("b", "yy")]).drop("text").withColumn("vector", F.array(F.lit(9.0))).withColumn("hash_format", F.lit(reindex.LEGACY)).withColumn("embedding_hash", F.lit(""))
    store.commit({"pages": store.write(old, "pages")})
    report = reindex.reindex(store, pages(spark, [("a", "x"), ("b", "changed")]), embedded)
    assert (report["legacy_migrated"], report["embedded"]) == (1, 1) and vectors(store) == {"a": [9.0], "b": [7.0]}
    assert {r.hash_format for r in store.table(store.latest().tables["pages"]).collect()} == {reindex.EXACT}


def test_texts_are_not_written_with_the_index(spark, tmp_path, monkeypatch):
    """A build keeps what it knows of pages, and opens texts for the embedder only."""
    kept, save = [], reindex.saved
    monkeypatch.setattr(reindex, "saved", lambda df: (kept.append(df.columns), save(df))[1])
    store = Published(spark, str(tmp_path / "store"))
    pages = lambda more: spark.range(9).select(F.concat(F.lit("p"), "id").alias("name"), F.concat(F.lit("t"), "id", F.lit(more)).alias("text")).select("*", F.sha2("text", 256).alias("embedding_hash"), F.sha2("text", 224).alias("body_hash"))
    seen = []
    embed = lambda rows: (seen.append(sorted(r.text for r in rows.collect())), rows.select("name", F.array(F.length("text").cast("double")).alias("vector")))[1]
    reindex.reindex(store, pages(""), embed)
    half = pages("").where("name < 'p5'").unionByName(pages(" new").where("name >= 'p5'"))
    assert reindex.reindex(store, half, embed)["embedded"] == 4
    assert seen == [[f"t{n}" for n in range(9)], [f"t{n} new" for n in range(5, 9)]] and not any("text" in c for c in kept)


def test_an_index_takes_less_disk_than_its_texts(spark, store, monkeypatch):
    """Texts and their words are neither written nor shuffled; what an ingest and a merge leave on disk is small beside them."""
    from chronolith.operators.order import shared_dir

    def size():
        tops = (store.path, shared_dir(spark).removeprefix("file:"))
        return sum(os.path.getsize(f"{d}/{f}") for top in tops for d, _, names in os.walk(top) for f in names)

    kept, plans, save, write = [], {}, postings.saved, Published.write
    monkeypatch.setattr(postings, "saved", lambda df: (kept.append(df.columns), save(df))[1])
    monkeypatch.setattr(Published, "write", lambda self, df, name, *a, **b: (plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString()), write(self, df, name, *a, **b))[1])
    word = lambda n: F.concat(F.lit("w"), F.pmod(F.xxhash64("id", F.lit(n)), F.lit(3000)))
    docs = spark.range(0, 3000, 1, 2).select("id", F.concat_ws(" ", *[word(n) for n in range(250)]).alias("text")).cache()
    texts, before = docs.agg(F.sum(F.length("text"))).first()[0], size()
    postings.ingest(store, docs)
    one = size() - before
    postings.merge(store)
    assert one < texts and size() - before < 2 * texts, (texts, one, size() - before)
    assert not any({"text", "words", "entries"} & set(c) for c in kept) and "Exchange" not in plans["slots"].replace("BroadcastExchange", "")


def test_slots_that_lost_most_documents_become_one(spark, store, monkeypatch):
    """Merging where less than half lives; empty texts, and ids that come twice, the larger text counting."""
    monkeypatch.setattr(postings, "SLOT", 8)
    docs = {i: " ".join(f"t{i % m}" for m in (2, 3, 5, 7, 11)[: i % 6]) for i in range(90)}
    twice = [(3, "t0"), (4, None), *docs.items()]
    postings.ingest(store, spark.createDataFrame(twice, "id long, text string"))
    postings.ingest(store, spark.createDataFrame([(500, "t1 t1")], "id long, text string"), spark.createDataFrame([(i,) for i in range(90) if i % 4], "id long"))
    queries = {1: "t0 t1", 2: "t3 t6", 3: "t10"}
    asked = spark.createDataFrame(list(queries.items()), "query_id long, query string")
    want = plain_bm25({i: max(docs[i], "") for i in docs if i % 4 == 0} | {500: "t1 t1"}, queries, 5)
    assert found(postings.search(store, asked, 5)) == want
    before = store.table(next(p for t, p in store.latest().tables.items() if t == "1/slots")).count()
    postings.merge(store)
    slots = store.table(next(p for t, p in store.latest().tables.items() if t.endswith("slots")))
    assert slots.count() < before and found(postings.search(store, asked, 5)) == want
