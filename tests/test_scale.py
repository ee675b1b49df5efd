"""Forms that touch only what they need: moved nodes, windows of reports, days of a log."""

import os
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from chronolith.operators import community, usage
from chronolith.sources import files


def plain_rounds(edges, labels, rounds):
    for _ in range(rounds):
        new = {}
        for n, own in labels.items():
            sums = defaultdict(int)
            for other, w in edges[n].items():
                sums[labels[other]] += w
            if not sums:
                new[n] = own
                continue
            rank, label = max((w, lab) for lab, w in sums.items())
            new[n] = label if rank > 1 else max(label, own)
        if new == labels:
            break
        labels = new
    return labels


def test_active_propagation_is_the_synchronous_one(spark, monkeypatch):
    rng, edges = random.Random(5), defaultdict(lambda: defaultdict(int))
    for _ in range(260):
        c = rng.randrange(8)
        a, b = c * 10 + rng.randrange(10), (c * 10 if rng.random() < 0.93 else rng.randrange(8) * 10) + rng.randrange(10)
        if a != b:
            edges[a][b] += 1
            edges[b][a] += 1
    graph = lambda: community.adjacency(spark.range(83).select(F.col("id").alias("node")), spark.createDataFrame([(a, b) for a in edges for b, w in edges[a].items() if a < b for _ in range(w)], "src long, dst long"))
    first, moved, save = {n: n for n in range(83)}, [], community.saved
    for rounds in (1, 3, 9):
        got = {r.node: r.label for r in community.propagate_active(graph(), rounds).collect()}
        assert got == plain_rounds(edges, first, rounds)
    monkeypatch.setattr(community, "saved", lambda df: (moved.append(df.count()) if "old" in df.columns else None, save(df))[1])
    last = {r.node: r.label for r in community.propagate_active(graph(), 9).collect()}
    assert moved[-1] < moved[0] / 2
    edges[3][77] += 9  # after new edges it goes on from the last labels
    edges[77][3] += 9
    begin = {n: last[n] for n in range(80)}
    monkeypatch.undo()
    start = spark.createDataFrame(list(begin.items()), "node long, label long")
    fresh = {n: max(begin.values()) + 1 + k for k, n in enumerate((80, 81, 82))}
    assert {r.node: r.label for r in community.propagate_active(graph(), 9, start).collect()} == plain_rounds(edges, begin | fresh, 9)


@pytest.mark.parametrize("seed", [1, 3, 8, 40])
def test_seeds_find_what_searching_finds(spark, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abé☃ ") for _ in range(rng.randrange(1, 5)))
    reports = ["".join(word() for _ in range(40)) for _ in range(12)] + ["", None, "AB éé"]
    gaps = [(n, reports[n % 12][(k := rng.randrange(60)) : k + rng.randrange(1, 60)].upper() if n % 2 else "".join(word() for _ in range(rng.randrange(1, 9)))) for n in range(80)] + [(90, ""), (91, "ab"), (92, "é")]
    g, p = spark.createDataFrame(gaps, "n long, q string"), spark.createDataFrame([(r,) for r in reports], "text string")
    found = usage.recurring_by_seeds(g, p, seed)
    assert sorted(r.n for r in found.collect()) == sorted(r.n for r in usage.recurring(g, p).collect())
    assert found.columns == g.columns and "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    assert usage.recurring_by_seeds(g.limit(0), p, seed).count() == 0 == usage.recurring_by_seeds(g.where("n = 91"), p.limit(0), seed).count()


def test_a_window_of_a_log_opens_its_days_only(spark, tmp_path):
    path = str(tmp_path / "log")
    events = spark.range(400).select((F.col("id") * 86400.0 + 7).alias("ts"), F.concat(F.lit("q"), "id").alias("query"))
    files.append_query_log(events.repartition(1), path)
    (tmp_path / "log" / "rotated.json").write_text('{"ts": 34473605.0, "query": "loose"}\n{"ts": 5.0, "query": "old"}\nbroken\n')
    now = 399 * 86400.0 + 10
    assert sorted(os.path.basename(p) for p in files.log_paths(spark, path, now - 86400)) == ["day=1971-02-02", "day=1971-02-03", "day=1971-02-04", "rotated.json"]
    for day in os.listdir(path):
        if day.startswith("day=") and day < "day=1971-02-02":
            for name in os.listdir(f"{path}/{day}"):
                os.remove(f"{path}/{day}/{name}")
            os.mkdir(f"{path}/{day}/opened.json")
    got = files.read_query_log(spark, path, now, 1)
    assert [r.query for r in got.collect()] == ["loose", "q399"] or [r.query for r in got.collect()] == ["q398", "loose", "q399"]
    assert len(got.inputFiles()) <= 4 and files.read_query_log(spark, str(tmp_path / "log"), now * 3, 0).count() == 0
