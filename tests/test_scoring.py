"""Scores by matrix products against plain loops: ties, odd vectors, several blocks."""

import math
import random

import pytest

from chronolith.operators import scoring, search


def ranks(scores, k):
    """{query: [(id, score)]} of {query: {id: score or None}}"""
    return {q: sorted(s.items(), key=lambda x: (x[1] is None, -(x[1] or 0), x[0]))[:k] for q, s in scores.items()}


def read(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r["rank"]):
        out.setdefault(r.query_id, []).append((r.id, r.score))
    return out


@pytest.mark.parametrize("ids", ["long", "string"])
def test_nearest_of_odd_vectors_and_ties(spark, ids):
    rng = random.Random(3)
    name = (lambda n: n) if ids == "long" else "v{}".format
    vectors = [(name(n), [rng.choice([0.0, 0.5, 1.0, -1.0]) for _ in range(4)]) for n in range(300)]
    vectors += [(name(900), None), (name(901), [1.0]), (name(902), [1e9, 1e9, -1.0, 3.0]), (name(903), [1.0, None, 1.0, 1.0])]
    asked = [(q, [rng.choice([0.0, 0.25, 1.0]) for _ in range(4)]) for q in range(9)] + [(50, [1e8, 1.0, 1.0, 1.0])]
    v, q = spark.createDataFrame(vectors, f"id {ids}, vector array<double>").repartition(5), spark.createDataFrame(asked, "query_id long, query array<double>")
    product = lambda a, b: None if a is None or len(a) != len(b) or None in a else round(sum(x * y for x, y in zip(a, b)), 6)
    want = ranks({n: {i: product(a, b) for i, a in vectors} for n, b in asked}, 7)
    assert read(search.vector_search(v, q, 7)) == want == read(search.vector_search(v, q, 7, block=3))
    assert search.vector_search(v, q.limit(0), 7).count() == 0 == search.vector_search(v.limit(0), q, 7).count()


def test_words_of_many_blocks_and_ties(spark, monkeypatch):
    rng = random.Random(4)
    word = lambda: rng.choice("abcdefgh") * rng.randrange(1, 3)
    docs = [(n, " ".join(word() for _ in range(rng.randrange(1, 6)))) for n in range(400)] + [(500, ""), (501, "none of"), (502, None)]
    asked = [(q, " ".join(word() for _ in range(3)) + " zz") for q in range(8)] + [(20, "nothing known"), (21, "")]
    d, q = spark.createDataFrame(docs, "id long, text string").repartition(4), spark.createDataFrame(asked, "query_id long, query string")
    split = {i: t.split() for i, t in docs if t is not None}
    n, mean = len(split), sum(map(len, split.values())) / len(split)
    df = lambda t: sum(t in w for w in split.values())
    part = lambda t, w: math.log(1 + (n - df(t) + 0.5) / (df(t) + 0.5)) * w.count(t) * 2.2 / (w.count(t) + 1.2 * (0.25 + 0.75 * len(w) / mean))
    scores = {k: {i: round(sum(part(t, w) for t in set(text.split())), 6) for i, w in split.items() if set(w) & set(text.split())} for k, text in asked}
    want = {k: v for k, v in ranks(scores, 12).items() if v}
    assert read(search.bm25(d, q, 12)) == want
    monkeypatch.setattr(scoring, "ASKED", 3)
    monkeypatch.setattr(scoring, "CELLS", 1)
    assert read(search.bm25(d, q, 12)) == want
    plan = search.bm25(d, q, 12)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan  # no row for each question and document is shuffled
