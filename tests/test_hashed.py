"""The queries that hash, and so have no SQL, against plain code with the same hashes."""

import re
from collections import defaultdict
from math import sqrt

import pytest
import xxhash

from chronolith.plans.catalog import QUERIES

MASK = 0xFFFFFFFF


def murmur(data: bytes, seed: int = 42) -> int:
    """Murmur3 of 32 bits whose last odd bytes are mixed one by one, as signed numbers."""
    rot = lambda x, r: ((x << r) | (x >> (32 - r))) & MASK
    h, whole = seed, len(data) // 4 * 4
    words = [int.from_bytes(data[i : i + 4], "little") for i in range(0, whole, 4)] + [b if b < 128 else b - 256 for b in data[whole:]]
    for k in words:
        h = (rot(h ^ (rot((k & MASK) * 0xCC9E2D51 & MASK, 15) * 0x1B873593 & MASK), 13) * 5 + 0xE6546B64) & MASK
    h ^= len(data)
    h = (h ^ (h >> 16)) * 0x85EBCA6B & MASK
    h = (h ^ (h >> 13)) * 0xC2B2AE35 & MASK
    return h ^ (h >> 16)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def test_embeddings(spark, sf):
    texts = {r.item_id: r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    got = {r.item_id: r.vector for r in QUERIES["answers_embeddings"](spark, sf).collect()}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        v = [0.0] * 64
        for w in re.findall("[a-z0-9]+", text.lower()):
            v[signed(xxhash.xxh64_intdigest(w.encode(), 42)) % 64] += 1.0 if murmur(w.encode()) % 2 == 0 else -1.0
        norm = sqrt(sum(x * x for x in v))
        assert list(got[i]) == pytest.approx([x / norm if norm else 0.0 for x in v], abs=1e-6)


def test_member_sample(spark, sf):
    rows = spark.read.parquet(f"{sf}/customer.parquet").collect()
    by = defaultdict(list)
    for r in rows:
        first = xxhash.xxh64_intdigest(r.c_custkey.to_bytes(8, "little", signed=True), 42)
        by[r.c_nationkey].append((signed(xxhash.xxh64_intdigest((42).to_bytes(4, "little"), first)), r.c_custkey))
    want = {(c, n) for c, members in by.items() for _, n in sorted(members)[:20]}
    assert {(r.community, r.node) for r in QUERIES["graph_member_sample"](spark, sf).collect()} == want
