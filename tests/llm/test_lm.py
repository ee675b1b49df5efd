import re
import zlib
from collections import Counter
from math import log10

import numpy as np
import pytest

from chronolith.llm import lm
from chronolith.llm.queries import QUERIES

from .awkward import empty, table


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


def brute(rows, held):
    c = Counter(w for i, t in rows if not held(i) for w in words(t))
    n, v = sum(c.values()), len(c)
    return sorted((i, len(words(t)), sum(c[w] > 0 for w in words(t)), n, sum(log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words(t))) for i, t in rows)


def same(got, want):
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert [g[4] for g in got] == pytest.approx([w[4] for w in want], rel=1e-9)


def test_query_matches_exact_counts(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(QUERIES["op9_lm_scoring"](spark, sf).collect(), key=lambda r: r.doc_id)
    out = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    same([(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got], brute(rows, out))
    assert [r.held_out for r in got] == [out(r.doc_id) for r in got]
    assert all(r.score < 0 and np.isfinite(r.score) for r in got)
    assert sum(r.score for r in got if not r.held_out) > sum(r.base_score for r in got if not r.held_out)


def test_small_batches_and_awkward_rows(spark, monkeypatch):
    df = table(spark)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    for size in (800_000, 20):
        monkeypatch.setattr(lm, "BATCH_TOKENS", size)
        got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in lm.score(df).collect()), key=lambda r: (r[0], r[1]))
        same(got, brute(rows, lambda i: False))
    assert lm.score(empty(spark)).count() == 0
    none = lm.score(spark.createDataFrame([(1, "a", True)], "doc_id long, text string, held boolean"), held_col="held").first()
    assert none.train_tokens == 0 and none.n_known == 0 and none.base_score == pytest.approx(0.0)


def test_filter_reads_back_what_went_in():
    rng = np.random.default_rng(0)
    buckets, bits = 4, 1 << 18
    hashes = rng.integers(0, 2**63, 4000, dtype=np.uint64)
    levels = rng.integers(1, 9, 4000).astype(np.uint8)
    segments = []
    for b in range(buckets):
        on = hashes % np.uint64(buckets) == b
        segments.append(lm.BloomCounts.segment((hashes[on] >> np.uint64(32)).astype(np.uint32), levels[on], bits))
    bloom = lm.BloomCounts(segments)
    back = bloom.levels(hashes, buckets)
    assert (back >= levels).all() and (back == levels).mean() > 0.99
    assert (bloom.levels(rng.integers(0, 2**63, 4000, dtype=np.uint64), buckets) == 0).mean() > 0.99


def test_a_filter_in_parts_scores_as_one(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    one, many = ({r.doc_id: tuple(r)[1:] for r in lm.score(docs, max_bits=m).collect()} for m in (lm.MAX_BITS, 1 << 15))
    assert one.keys() == many.keys()
    assert all(one[k][:3] == many[k][:3] and one[k][3:] == pytest.approx(many[k][3:], rel=1e-9) for k in one)


@pytest.mark.parametrize("max_bits", [lm.MAX_BITS, 0])  # broadcast, and probed where it is built
def test_score_is_the_smoothed_model(spark, sf, monkeypatch, max_bits):
    """Against plain counts of n-grams, as levels; a filter so wide that it gives no false count."""
    monkeypatch.setattr(lm, "BATCH_TOKENS", 30_000)
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()][:150] + [(1000, None), (1001, "a"), (1001, "a")]
    held = lambda i: i % 5 == 1
    df = spark.createDataFrame([(i, t, held(i)) for i, t in rows], "doc_id long, text string, held boolean")
    got = sorted((r.doc_id, r.score) for r in lm.score(df, held_col="held", max_bits=max_bits, bits_per_member=60).collect())
    counts = Counter()
    for i, t in rows:
        w = [None, *words(t)]
        if not held(i):
            counts.update((x,) for x in w[1:])
            counts.update(zip(w, w[1:]))
            counts.update(zip(w, w[1:], w[2:]))
    level = {g: 1.5 * 2.0 ** (n.bit_length() - 1) - 0.5 for g, n in counts.items()}
    n, v = sum(c for g, c in counts.items() if len(g) == 1), sum(len(g) == 1 for g in counts)
    c = lambda *g: level.get(g, 0.0)
    s2, s3 = lm.STRENGTHS

    def log_p(t):
        w, out = [None, *words(t)], 0.0
        for k in range(1, len(w)):
            p = (c(w[k]) + 0.5) / (n + 0.5 * (v + 1))
            p = (min(c(w[k - 1], w[k]), c(w[k - 1])) + s2 * p) / (c(w[k - 1]) + s2)
            if k > 1:
                context = c(w[k - 2], w[k - 1])
                p = (min(c(w[k - 2], w[k - 1], w[k]), context) + s3 * p) / (context + s3)
            out += log10(p)
        return out

    want = sorted((i, log_p(t)) for i, t in rows)
    assert [i for i, _ in got] == [i for i, _ in want]
    assert [x for _, x in got] == pytest.approx([x for _, x in want], rel=1e-6)


def test_work_is_done_once_for_each_distinct_ngram(monkeypatch):
    """A text that stands 50 times, in one batch and in 50: its n-grams are hashed once, and probed once."""
    flow, sizes, upper = np.tile(np.arange(1, 40), 50), np.full(50, 39), np.arange(40, dtype=np.uint32) * 7919
    mixed, mix = [], lm.mix
    monkeypatch.setattr(lm, "mix", lambda x: mixed.append(len(x)) or mix(x))
    hashes, *places = lm.distinct_ngrams(flow, sizes, upper)
    assert sum(mixed) == len(hashes) == 40 + 39 + 38
    assert all(len(set(zip(flow[2:39], p[2:39]))) == 37 for p in places)
    probed, probe = [], lm.BloomCounts.probe
    monkeypatch.setattr(lm.BloomCounts, "probe", lambda self, keys, n: probed.append(len(keys)) or probe(self, keys, n))
    keys = np.sort(np.random.default_rng(0).choice(2**32, 1000, replace=False).astype(np.uint64))
    found = lm.read_back([keys] * 50, [np.arange(1000) % 3] * 50, 60)
    assert probed == [1000]
    assert len(found) == 50 and all((x == np.where(np.arange(1000) % 3, 6 + np.arange(1000) % 3 // 2, 0)).all() for x in found)


def test_a_filters_places_are_start_and_strides():
    keys = np.random.default_rng(1).integers(0, 2**32, 500, dtype=np.uint64)
    for bits in (64, 1 << 20, (1 << 31) - 8, (1 << 33) + 8):  # the last in 64-bit numbers
        h = lm.mix(keys * np.uint64(64) + np.uint64(3) + np.uint64(0x9E3779B97F4A7C15)).tolist()
        at, stride = lm.BloomCounts.seeds(keys, 3, bits)
        for k in range(lm.PROBES):
            assert at.tolist() == [((x >> 32) + k * (x & 0xFFFFFFFF | 1)) % bits for x in h]
            at = lm.BloomCounts.step(at, stride, bits)


@pytest.mark.parametrize("size", [1, 30, 2_000_000])
def test_tokens_are_those_of_split(monkeypatch, size):
    monkeypatch.setattr(lm, "PORTION_BYTES", size)
    texts = [b"", b" ", b"a", b"A\tb\n\nc\v\fD\r", "É x Y z\x1c\x85".encode(), b"\x00 \xff\x1f", b"", bytes(range(256)) * 3, b" end "]
    for some in (texts, texts[:1], texts[2:3], []):
        got = []
        for run in lm.portions(some):
            for n, letters, lengths in lm.tokens(run):
                got.append(lm.token_array(letters, lengths).to_pylist())
                assert n == len(got[-1])
        assert got == [t.lower().split() for t in some]


def test_numbers_and_orders_with_and_without_room():
    """Values and places in one 64-bit number, and apart; keys of so many buckets that they ascend only in part."""
    values = np.random.default_rng(2).integers(0, 50, 300, dtype=np.uint64)
    for bits in (6, 60):
        distinct, number = lm.numbered(values, bits)
        assert distinct.tolist() == sorted(set(values.tolist())) and (distinct[number] == values).all()
        assert [x.tolist() for x in lm.ordered(values, bits)] == [np.sort(values).tolist(), np.argsort(values, kind="stable").tolist()]
    assert [len(x) for x in lm.numbered(values[:0], 6)] == [0, 0]
    hashes = np.random.default_rng(3).integers(0, 2**63, 3000, dtype=np.uint64)
    for buckets in (1, 7, 64, 1 << 24):
        order, cuts = lm.dealt(hashes, buckets)
        assert sorted(order.tolist()) == list(range(3000)) and len(cuts) == buckets + 1
        bucket = (hashes % np.uint64(buckets))[order]
        assert (np.repeat(np.arange(buckets), np.diff(cuts)) == bucket).all()
        keys = (hashes >> np.uint64(32))[order]
        assert (lm.unpack_keys(lm.pack_keys(keys)) == keys).all()
