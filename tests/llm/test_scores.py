import os
import random
import re
import zlib
from collections import Counter
from math import exp, log, log2, sqrt

import numpy as np
import pytest

from chronolith.llm import quality, toxicity
from chronolith.llm.common import Scratch
from chronolith.llm.queries import QUERIES

from .awkward import empty, table


def crc(i, n):
    return zlib.crc32(str(i).encode()) % n


@pytest.fixture(scope="module")
def labels(spark):
    return {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}


@pytest.mark.parametrize(
    ("name", "label", "mod", "left_out", "threshold", "least"),
    [("op8_quality_nbsvm", "quality", 3, 1, 0.5, 0.95), ("op3_toxicity_neighbours", "toxic", 4, 2, 0.3, 0.85)],
)
def test_held_out_accuracy(spark, labels, name, label, mod, left_out, threshold, least):
    rows = QUERIES[name](spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == 1000
    assert all(r.held_out == (crc(r.doc_id, mod) == left_out) and 0 <= r.score <= 1 and r.predicted == (r.score >= threshold) for r in rows)
    held = [(r.predicted, labels[r.doc_id][label]) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([p == y for p, y in held]) >= least


@pytest.mark.parametrize(("name", "label", "mod", "left_out"), [("op8_quality_nbsvm", "quality", 3, 1), ("op3_toxicity_neighbours", "toxic", 4, 2)])
def test_held_out_labels_are_not_read(spark, sf, tmp_path, name, label, mod, left_out):
    """The whole query, with the labels of all rows held out turned round, and with those of the others."""
    before = {r.doc_id: r.score for r in QUERIES[name](spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/labels.parquet").collect()
    os.symlink(f"{sf}/documents.parquet", tmp_path / "documents.parquet")
    for turned in (True, False):
        flipped = [r.asDict() | ({label: 1 - r[label]} if r[label] is not None and (crc(r.doc_id, mod) == left_out) == turned else {}) for r in rows]
        spark.createDataFrame(flipped, spark.read.parquet(f"{sf}/labels.parquet").schema).write.mode("overwrite").parquet(str(tmp_path / "labels.parquet"))
        after = {r.doc_id: r.score for r in QUERIES[name](spark, str(tmp_path)).collect()}
        assert (after == before) == turned


def plain_quality(texts, y, epochs=20):
    """Naive Bayes support vectors with a dense matrix: all indicators of every text, and a plain dual solver."""
    grams = quality.Grams()
    found = [grams.of(t.encode()) for t in texts]
    columns = np.unique(np.concatenate(found))
    x = np.array([np.isin(columns, f) for f in found], dtype=float)
    outside = (1 << quality.BITS) - len(columns)
    p, q = 1 + x[y == 1].sum(axis=0), 1 + x[y == 0].sum(axis=0)
    r = np.log((p / (p.sum() + outside)) / (q / (q.sum() + outside)))
    z, s, alpha = np.column_stack((x * r, np.ones(len(x)))), np.where(y == 1, 1.0, -1.0), np.zeros(len(x))
    rng = np.random.default_rng(0)
    for _ in range(epochs):
        most = 0.0
        for i in rng.permutation(len(x)):
            w = (alpha * s) @ z
            new = min(max(alpha[i] - (s[i] * (z[i] @ w) - 1) / (z[i] @ z[i]), 0.0), 1.0)
            most, alpha[i] = max(most, abs(new - alpha[i])), new
        if most < 1e-3:
            break
    w = (alpha * s) @ z
    mean = np.abs(w[:-1]).sum() / (1 << quality.BITS)
    return x @ ((0.75 * mean + 0.25 * w[:-1]) * r) + 0.25 * w[-1]


def test_quality_margins_equal_a_dense_solver():
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["good", "fine", "words", "here", "now"] if n % 2 else ["bad", "spam", "words", "here", "buy"]) for _ in range(rng.randrange(3, 12))) for n in range(50)]
    y, grams = np.array([n % 2 if n % 9 else 1 - n % 2 for n in range(50)]), quality.Grams()
    rows = [grams.of(t.encode()) for t in texts]
    weights, bias = quality.hinge(rows, y, quality.log_count_ratio(rows, y))
    got = np.array([weights[r].sum() + bias for r in rows])
    assert np.allclose(got, plain_quality(texts, y), atol=1e-6) and got.std() > 0.1


def test_awkward_rows_and_missing_labels(spark):
    df = table(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(0, 0, 1), (0, 0, 1), (3, 1, 0), (4, None, None), (None, 1, 1), (6, 1, 0), (8, 0, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    for labels in (none, some):
        model = quality.train(df, labels)
        assert len([r for r in quality.score(df, model).collect() if 0 <= r.score <= 1]) == df.count()
        assert len([r for r in toxicity.toxicity(df, labels).collect() if 0 <= r.score <= 1]) == df.count()
        assert quality.score(empty(spark), model).count() == toxicity.toxicity(empty(spark), labels).count() == 0


def plain_toxicity(docs, labels):
    """Scores and evidence by comparing every text with every example, term by term."""
    found = {i: Counter(re.findall(r"\w+", (t or "").lower())) for i, t in docs}
    df, n = Counter(w for c in found.values() for w in c), len(docs)
    ids = sorted(i for i in labels if i in found)
    known = {w for i in ids for w in found[i]}
    pos, neg = (Counter(w for i in ids if labels[i] == y for w in found[i]) for y in (1, 0))

    def unit(c):
        w = {t: (1 + log(k)) * ((1 + log((1 + n) / (1 + df[t]))) * log2(2 + pos[t] / max(1, neg[t])) if t in known else 1 + log(1 + n)) for t, k in c.items()}
        size = sqrt(sum(x * x for x in w.values())) or 1
        return {t: x / size for t, x in w.items()}

    vectors, base = {i: unit(found[i]) for i in found}, (sum(labels[i] for i in ids) + 1) / (len(ids) + 2)

    def nearest(i, skip=None):
        rows = [(-round(sum(x * vectors[e].get(t, 0) for t, x in vectors[i].items()), 6), e) for e in ids if e != skip]
        return [(-c, e) for c, e in sorted(rows) if c < 0][: toxicity.NEIGHBOURS]

    def odds(near):
        w = [(1 / (1.02 - min(c, 1.0)), labels[e]) for c, e in near]
        return log((sum(x * y for x, y in w) + toxicity.PRIOR * base) / (sum(x * (1 - y) for x, y in w) + toxicity.PRIOR * (1 - base)))

    pairs = sorted((odds(nearest(i, skip=i)), labels[i]) for i in ids)
    slope, shift = quality.sigmoid_fit(np.array([o for o, _ in pairs]), np.array([y for _, y in pairs]))
    return {i: (1 / (1 + exp(-(slope * odds(near) + shift))), [e for _, e in near[:3]]) for i in found for near in [nearest(i)]}


def test_toxicity_equals_comparing_everything(spark, tmp_path):
    """The whole query against brute force: exact cosines over all terms, all examples in the calibration."""
    rng = random.Random(3)
    words = [f"w{n}" for n in range(60)]
    docs = []
    for i in range(260):
        text = " ".join(rng.choices(words, k=rng.randrange(25)) + ["vile", "nasty"][: rng.randrange(3)] * (i % 5 == 0))
        docs.append((i, text if i % 41 else None))
    docs += [(260 + k, docs[k * 5][1]) for k in range(8)]
    labels = {i: int(i % 5 == 0) for i in range(0, 268, 2)}
    spark.createDataFrame(docs, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([*labels.items()], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = QUERIES["op3_toxicity_neighbours"](spark, str(tmp_path)).collect()
    want = plain_toxicity(docs, {i: y for i, y in labels.items() if crc(i, 4) != 2})
    assert len(rows) == len(want) == 268
    for r in rows:
        assert r.score == pytest.approx(want[r.doc_id][0], abs=1e-6)
        assert [e.id for e in r.evidence] == want[r.doc_id][1]


def test_no_repeat_indicator_hides_an_ngram():
    g = quality.Grams()
    for text in (b"a b c d", b"x x x x x x x x x x x x", b"", b"one"):
        plain = np.unique(g.hashes(np.frombuffer(b" " + text + b"  ", np.uint8).astype(np.uint32), 3))
        assert np.isin(plain, g.of(text)).all()
    assert not np.array_equal(g.of(b"ab ab ab"), g.of(b"ab abab"))


def test_examples_are_bounded_in_bytes(spark):
    docs = spark.createDataFrame([(i, "x" * 100 + str(i)) for i in range(40)] + [(3, "a")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (4, None)], "doc_id long, quality int")
    scratch = Scratch(spark, "test")
    every = quality.sample(docs, labels, "doc_id", "text", "quality", scratch, 6000, 10**6).collect()
    assert len(every) == 40 and {r.id: r.text for r in every}[3] == "a"
    some = quality.sample(docs, labels, "doc_id", "text", "quality", scratch, 6000, 1000).collect()
    assert sum(len(r.text) for r in some) <= 1000 and len(some) >= 8
    assert quality.sample(docs, labels, "doc_id", "text", "quality", scratch, 5, 10**6).count() == 5


def test_dual_coordinate_descent_separates():
    rng = np.random.default_rng(4)
    rows, y = [], np.array([i % 2 for i in range(80)])
    for label in y:
        rows.append(np.unique(np.concatenate((rng.choice(500, 20), [1000 + label]))))
    model = quality.fit(rows, y)
    assert all((model.score(x) >= 0.5) == bool(label) for x, label in zip(rows, y))
