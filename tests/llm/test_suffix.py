import hashlib
from collections import defaultdict

import numpy as np

from chronolith.llm import suffix
from chronolith.llm.queries import QUERIES

from .awkward import empty, table


def brute(rows, length=50):
    """(id, n_bytes, spans, sha256 of the rest) of each row, by a table of all windows."""
    low = {}
    data = [(i, (t or "").encode()) for i, t in rows]
    for i, d in data:
        for s in range(len(d) - length + 1):
            w = d[s : s + length]
            low[w] = min(low.get(w, i), i)
    out = []
    for i, d in data:
        gone = np.zeros(len(d), bool)
        for s in range(len(d) - length + 1):
            if low[d[s : s + length]] < i:
                gone[s : s + length] = True
        edge = np.diff(np.pad(gone, 1).astype(int))
        spans = list(zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) - np.flatnonzero(edge == 1)).tolist()))
        out.append((i, len(d), spans, hashlib.sha256(np.frombuffer(d, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out)


def got(df):
    return sorted((r.doc_id, r.n_bytes, list(zip(r.starts, r.lengths)), r.kept_sha256) for r in df.collect())


def test_query_matches_brute_force(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows = QUERIES["op4_suffix_array_dedup"](spark, sf).collect()
    want = brute(docs)
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows) == [(i, n, sum(x for _, x in s), len(s), h) for i, n, s, h in want]


def made_up(seed):
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("abé"), 3)) for _ in range(12)]
    line = " ".join(rng.choice(words, 30))
    rows = []
    for i in range(40):
        own = " ".join(rng.choice(words, 40))
        cut = int(rng.integers(0, 60))
        rows.append((i, own + line[cut : cut + 80] + (own[:70] if i % 3 else "x" * 90)))
    return rows


def test_small_alphabets_hot_anchors_and_other_lengths(spark):
    for seed, length, hot in ((1, 50, 20_000), (2, 50, 3), (3, 24, 5), (4, 100, 20_000)):
        rows = made_up(seed)
        df = spark.createDataFrame(rows, "doc_id long, text string")
        assert got(suffix.remove_repeats(df, length=length, hot=hot)) == brute(rows, length), (seed, length, hot)


def test_awkward_rows(spark):
    df = table(spark)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert got(suffix.remove_repeats(df)) == brute(rows)
    assert suffix.remove_repeats(empty(spark)).count() == 0
    text = {r.doc_id: r.kept for r in suffix.remove_repeats(df, with_text=True).collect()}
    assert text[3] == "one" and text[7] == "" and text[6] == rows[6][1]


def test_runs_of_marked_windows_follow_the_suffix_order():
    rng = np.random.default_rng(5)
    m = rng.integers(0, 2, (60, 84)).astype(np.uint8)
    m[30:] = m[:30]
    m[30:, :10] = 7
    ids = rng.permutation(60)
    ahead, behind = np.full(60, 34, np.uint8), np.zeros(60, np.uint8)
    marks = suffix.repeated_windows(m, ids, ahead, behind, 50)
    for d in range(35):
        by = defaultdict(list)
        for n in range(60):
            by[m[n, 34 - d : 84 - d].tobytes()].append(ids[n])
        assert [bool(x) for x in marks[:, d]] == [min(by[m[n, 34 - d : 84 - d].tobytes()]) < ids[n] for n in range(60)]
