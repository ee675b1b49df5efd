import re
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from chronolith.llm import simhash
from chronolith.llm.common import Scratch, components
from chronolith.llm.queries import QUERIES

from .awkward import empty, table

WIDE = simhash.Plan(lanes=3, bits=32, positions=16, least=2, width=2)


def plain_fingerprint(text, words=4):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    tokens = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not tokens:
        return 0
    grams = [" ".join(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))]
    h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute(rows, bits=4, words=4):
    fps = np.array([plain_fingerprint(t, words) for _, t in rows], dtype=np.uint64)
    ids = [i for i, _ in rows]
    label = list(range(len(rows)))

    def root(a):
        while label[a] != a:
            a = label[a]
        return a

    for a in range(len(rows)):
        for b in np.flatnonzero(np.bitwise_count(fps[a] ^ fps[a + 1 :]) <= bits) + a + 1:
            x, y = root(a), root(int(b))
            label[max(x, y)] = min(x, y)
    low = {}
    for n, i in enumerate(ids):
        r = root(n)
        low[r] = min(low.get(r, i), i)
    return sorted((i, f"{int(fps[n]):016x}", low[root(n)]) for n, i in enumerate(ids))


def test_query_matches_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = QUERIES["op5_simhash_near_dedup"](spark, sf)
    assert got.columns[:3] == ["doc_id", "fingerprint", "component_id"]
    assert sorted(map(tuple, got.collect())) == brute([tuple(r) for r in docs])


def test_awkward_rows(spark):
    df = table(spark)
    got = sorted(map(tuple, simhash.near_duplicates(df).collect()))
    assert got == brute([(r.doc_id, r.text) for r in df.collect()])
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_every_radius_and_the_block_path(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 6, dtype=np.uint64)
    near = [b ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, 3, dtype=np.uint64)) for b in base for _ in range(60)]
    fps = np.unique(np.concatenate([base, np.array(near, dtype=np.uint64), rng.integers(0, 2**63, 200, dtype=np.uint64)]))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "f0 long")
    for bits, width, limit in ((4, 3, 4096), (4, 3, 16), (6, 2, 32), (2, 3, 7), (7, 1, 64)):
        scratch, plan = Scratch(spark, "t"), simhash.Plan(1, bits, 8, 8 - bits, width)
        edges = simhash.links(spark, df.select(F.explode(simhash.posting_keys(plan)).alias("key"), "f0"), plan, scratch, limit).withColumnsRenamed({"a0": "a", "b0": "b"})
        got = components(edges, scratch).collect()
        comp = {r[0]: r[1] for r in got}
        label = {int(x): int(x) for x in fps.view(np.int64)}
        changed = True
        near_of = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= bits
        v = fps.view(np.int64).copy()
        while changed:
            new = np.where(near_of, v[None, :], np.iinfo(np.int64).max).min(axis=1)
            changed = bool((new != v).any())
            v = new
        label = dict(zip(fps.view(np.int64).tolist(), v.tolist()))
        assert {x: comp.get(x, x) for x in label} == label, (bits, limit)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (5, 5)], "a long, b long")
    got = {r[0]: r[1] for r in components(edges, Scratch(spark, "t")).collect()}
    assert Counter(got.values()) == {0: 301, 1000: 2}


def test_components_with_hubs(spark):
    """A third of all edges at one end, and ties; as one label for each group."""
    rng = np.random.default_rng(6)
    edges = [(7, 100_000 + i) for i in range(3000)] + [(int(a), int(b)) for a, b in rng.integers(0, 6000, (2500, 2))] + [(100_000, 9)] * 3
    got = {r[0]: r[1] for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    label = {x: x for e in edges if e[0] != e[1] for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a != b and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    assert got == label
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).count() == 0


def test_forest_of_one_large_group_and_strays():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, (1, 3), dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 63, (1500, 3), dtype=np.uint64)
    x = np.concatenate((base ^ flips, rng.integers(0, 2**63, (700, 3), dtype=np.uint64)))
    x = np.ascontiguousarray(x[rng.permutation(len(x))])
    i, j = simhash.forest(x, WIDE)
    assert len(i) == 1499 and simhash.near(x[i[:50]], x[j[:50]], WIDE).diagonal().all()
