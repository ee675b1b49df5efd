"""Counters against plain Python: resets inside windows, edges, pieces, quantiles."""

import math
import random
from collections import defaultdict

import pytest

from chronolith.operators import counters, order


def plain_increases(samples, window, step):
    by = defaultdict(list)
    for series, at, value in samples:
        by[series].append((at, value))
    out = {}
    for series, rows in by.items():
        rows.sort()
        for end in range(0, int(max(a for a, _ in rows)) + window + step, step):
            inside = [r for r in rows if end - window < r[0] <= end]
            if len(inside) < 2 or inside[0][0] == inside[-1][0]:
                continue
            rise = inside[-1][1] - inside[0][1] + sum(p for (_, p), (_, v) in zip(inside, inside[1:]) if v < p)
            span = inside[-1][0] - inside[0][0]
            mean = span / (len(inside) - 1)
            left, right = inside[0][0] - (end - window), end - inside[-1][0]
            left = left if left < 1.1 * mean else mean / 2
            right = right if right < 1.1 * mean else mean / 2
            if rise > 0 and inside[0][1] >= 0:
                left = min(left, span * inside[0][1] / rise)
            out[series, end] = (len(inside), rise * (span + left + right) / span)
    return out


def as_dict(df):
    return {(r.series, r.at): (r.n, pytest.approx(r.increase)) for r in df.collect()}


@pytest.mark.parametrize("width", [7, 100, 10_000])
def test_increases_equal_plain_code_with_resets_anywhere(spark, width):
    rng, samples = random.Random(width), []
    for series in ("a", "b", ""):
        at = value = 0
        for _ in range(120):
            at += rng.choice([1, 5, 15, 15, 15, 40, 200])
            value = rng.randrange(5) if rng.random() < 0.08 else value + rng.randrange(9)
            samples.append((series, float(at), float(value)))
    df = spark.createDataFrame(samples, "series string, at double, value double").repartition(5)
    got, want = as_dict(counters.increases(df, ["series"], 60, 20, width)), plain_increases(samples, 60, 20)
    assert got == want and len(want) > 100


def test_a_reset_inside_a_window(spark):
    samples = [("s", t, v) for t, v in ((5.0, 100.0), (15.0, 110.0), (25.0, 4.0), (35.0, 9.0), (45.0, 9.0), (55.0, 20.0))]
    got = {r.at: r for r in counters.increases(spark.createDataFrame(samples, "series string, at double, value double"), ["series"], 60, 60).collect()}
    # 10 before the reset, 4 up to and 16 after it; the samples' 50 seconds reach both edges
    assert got[60].n == 6 and got[60].increase == pytest.approx(30 * 60 / 50) and got[60].rate == pytest.approx(0.6)


def test_missing_and_repeated_samples(spark):
    rows = [(None, 1.0, 1.0), (None, 2.0, 3.0), ("x", None, 1.0), ("x", 1.0, None), ("y", 5.0, 1.0), ("y", 5.0, 1.0), ("z", 1.0, 1.0)]
    df = spark.createDataFrame([(*r, 9) for r in rows], "series string, at double, value double, piece int")
    assert {r.series for r in counters.increases(df, ["series"], 10, 10).collect()} == {""}
    assert counters.increases(df.limit(0), ["series"], 10, 10).count() == 0


def plain_quantile(buckets, q):
    merged = defaultdict(float)
    for le, n in buckets:
        merged[le] += n
    b = sorted(merged.items())
    if len(b) < 2 or b[-1][0] != math.inf:
        return math.nan
    high, cum = 0, []
    for le, n in b:
        high = max(high, n)
        cum.append((le, high))
    total = cum[-1][1]
    if total == 0:
        return math.nan
    if q < 0 or q > 1:
        return math.copysign(math.inf, q)
    k = next(i for i, (_, n) in enumerate(cum) if n >= q * total)
    if k == len(cum) - 1:
        return cum[-2][0]
    if k == 0 and cum[0][0] <= 0:
        return cum[0][0]
    start, under = cum[k - 1] if k else (0, 0)
    return start + (cum[k][0] - start) * (q * total - under) / (cum[k][1] - under) if cum[k][1] > under else math.nan


@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.95, 1.0, -1.0, 1.5])
def test_quantiles_equal_plain_code(spark, q):
    rng = random.Random(4)
    inf = math.inf
    groups = {"whole": [(0.1, 2.0), (0.5, 5.0), (1.0, 9.0), (inf, 10.0)], "beyond": [(0.1, 0.0), (1.0, 1.0), (inf, 100.0)], "none": [(0.1, 0.0), (inf, 0.0)], "open": [(0.1, 3.0), (1.0, 4.0)], "single": [(inf, 3.0)],
              "below zero": [(-2.0, 3.0), (0.0, 4.0), (inf, 8.0)], "falling": [(0.1, 5.0), (0.5, 3.0), (1.0, 6.0), (inf, 6.0)], "twice": [(0.1, 1.0), (0.1, 2.0), (inf, 4.0)]}
    for n in range(20):
        at = 0
        groups[f"r{n}"] = [(float(le), float(at := at + rng.randrange(4))) for le in (1, 2, 4, 8)] + [(inf, float(at + rng.randrange(3)))]
    df = spark.createDataFrame([(g, *b) for g, bs in groups.items() for b in bs], "g string, le double, n double").repartition(3)
    got = {r.g: r.value for r in counters.histogram_quantile(df, ["g"], q).collect()}
    assert got == {g: pytest.approx(plain_quantile(b, q), nan_ok=True) for g, b in groups.items()}


def test_rules_hold_over_counters(spark):
    gauges = spark.createDataFrame([("a", float(t), 1, 0 if t < 900 else 1) for t in range(0, 3600, 30)], "instance string, at double, up int, index_ready int")
    rest = [c for c in ("index_degraded", "index_age", "graph_ready", "pending", "lag", "blocked", "inbox", "deferred", "review", "community_age")]
    gauges = gauges.selectExpr("*", *[f"cast(null as int) as {c}" for c in rest])
    answers = spark.createDataFrame([(c, g, float(t), (t % 1800) * w) for t in range(0, 3600, 30) for c, g, w in (("high", "true", 0.5), ("error", "true", 0.05), ("high", "false", 0.01))], "confidence string, grounded string, at double, value double")
    drops = spark.createDataFrame([(o, float(t), float(v)) for t in range(0, 3600, 30) for o, v in (("success", t), ("conflict", int(t >= 2000)))], "outcome string, at double, value double")
    fired = defaultdict(list)
    for r in counters.counter_alerts(gauges, ["instance"], answers, drops).collect():
        fired[r.rule].append(r.at)
    assert set(fired) == {"index_unready", "answer_quality", "note_drop_failures"} | ({"server_down"} & set(fired))
    assert min(fired["index_unready"]) == 600 and max(fired["index_unready"]) < 960
    assert min(fired["note_drop_failures"]) == 2340 and max(fired["note_drop_failures"]) <= 2640


def test_samples_are_ordered_once_and_by_no_task_as_a_whole(spark, monkeypatch):
    made, parts = counters.saved, []
    monkeypatch.setattr(counters, "saved", lambda df: (parts.append(df.rdd.getNumPartitions()), made(df))[1])
    monkeypatch.setattr(counters, "dealt", lambda rows, *keys: order.dealt(rows, *keys, most=100))
    samples = [(s, float(t), float(t % 700)) for s in "ab" for t in range(0, 6000, 5)]
    df = spark.createDataFrame(samples, "series string, at double, value double")
    got = counters.increases(df, ["series"], 60, 20)
    assert as_dict(got) == plain_increases(samples, 60, 20) and parts == [24]
