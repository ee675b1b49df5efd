import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolith.llm import negatives
from chronolith.llm.queries import ORACLE_SQL, QUERIES

NAMES = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def as_rows(df):
    return sorted(tuple(r) for r in df.select(*NAMES).collect())


def plain(rows, positives=5, negs=5, low=80, high=100):
    """Every anchor against every row, in Python's integers."""
    rows = [r for r in rows if None not in r[:3]]
    out = []
    for n, (i, label, v, anchor) in enumerate(rows):
        if not anchor:
            continue
        all_ = sorted((-sum(a * b for a, b in zip(v, w)), j, m, other) for m, (j, other, w, _) in enumerate(rows) if m != n)
        for p, j, _, other in [x for x in all_ if x[3] == label][:positives]:
            fit = [x for x in all_ if x[3] != label and low * -p <= 100 * -x[0] <= high * -p]
            out.extend((i, j, k, x[1], -p, -x[0]) for k, x in enumerate(fit[:negs], 1))
    return sorted(out)


def made(n, seed, width=6, labels=4, spread=40):
    rng = random.Random(seed)
    centres = [[rng.randrange(-90, 90) for _ in range(width)] for _ in range(7)]
    return [(i, rng.randrange(labels), [x + rng.randrange(-spread, spread) for x in rng.choice(centres)], i % 5 == 0) for i in range(n)]


SCHEMA = "id long, label int, vector array<long>, anchor boolean"


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.001", "/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_query_equals_its_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf_dir}/embeddings.parquet'")
    want = con.execute(f"select {', '.join(NAMES)} from ({ORACLE_SQL['op12_hard_negatives']})").fetchall()
    assert as_rows(QUERIES["op12_hard_negatives"](spark, sf_dir)) == sorted(want) and want


@pytest.mark.parametrize(("seed", "spread", "group", "chunk"), [(1, 40, 3, 50), (2, 3, 4, 90), (3, 200, 1, 1000), (4, 1, 1000, 10)])
def test_many_groups_and_chunks_equal_plain_integers(spark, seed, spread, group, chunk):
    rows = made(300, seed, spread=spread)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert as_rows(negatives.hard_negatives(df, pivots=8, group_anchors=group, chunk_rows=chunk)) == plain(rows)


def test_bounds_spare_copies_where_rows_lie_in_clusters(spark, monkeypatch):
    rows, sent = made(400, 5, spread=4, width=8), []
    meet = negatives.meet
    monkeypatch.setattr(negatives, "meet", lambda r, a, *rest: (sent.append((r.count(), a.select("group").distinct().count())), meet(r, a, *rest))[1])
    got = negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA), pivots=12, group_anchors=5)
    assert as_rows(got) == plain(rows)
    for copies, groups in sent:
        assert copies < len(rows) * groups / 2


def test_without_broadcast_bounds(spark, monkeypatch):
    monkeypatch.setattr(negatives, "FEW_BOUNDS", 0)
    rows = made(120, 7)
    assert as_rows(negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA), pivots=4, group_anchors=6)) == plain(rows)


def test_ties_copies_and_awkward_rows(spark):
    rows = [(n % 40, n % 3, [5, -5, n % 2], n % 4 == 0) for n in range(90)]
    rows += [(None, 1, [1, 1, 1], True), (200, None, [1, 1, 1], True), (201, 1, None, True), (202, 1, [9], True), (203, 2, [], True), (204, 0, [5, -5, 0], None), (205, 9, [-90, 90, 0], True), (206, 9, [90, -90, 0], False)]
    df = spark.createDataFrame([(*r, 7, "x", 1) for r in rows], f"{SCHEMA}, uid long, cell string, group int")
    want = plain([(*r[:3], bool(r[3])) for r in rows])
    assert as_rows(negatives.hard_negatives(df.repartition(4), pivots=3, group_anchors=4, chunk_rows=20)) == want
    assert negatives.hard_negatives(df.limit(0)).count() == 0
    assert negatives.hard_negatives(df.withColumn("anchor", F.lit(False))).count() == 0


def test_large_numbers_stay_exact(spark):
    rng = random.Random(9)
    rows = [(n, n % 2, [2**29 + rng.randrange(3), -(2**29) + rng.randrange(3), rng.randrange(5)], n % 10 == 0) for n in range(60)]
    rows.append((99, 0, [2**31, 2**31, 0], True))  # takes no part
    assert as_rows(negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA))) == plain(rows[:-1])


def test_components_that_are_no_numbers(spark):
    rows = [(0, [0.5, -0.001]), (1, None), (2, [1.0, None]), (3, [float("nan"), 0.0]), (4, [float("-inf"), 0.0]), (5, [])]
    got = spark.createDataFrame(rows, "id long, e array<float>").select("id", negatives.whole_components(F.col("e")).alias("v")).collect()
    assert {r.id: r.v for r in got} == {0: [128, -1], 1: None, 2: None, 3: None, 4: None, 5: []}


def test_groups_hold_few_anchors():
    cells = {c: n for c, n in enumerate([3, 4, 1, 20, 2, 9])}
    got = negatives.groups_of_cells(cells, 8)
    load = {}
    for cell, group, splits in got:
        for g in range(group, group + splits):
            load[g] = load.get(g, 0) + cells[cell] / splits
    assert [c for c, *_ in got] == list(cells) and max(load.values()) <= 8 and sorted(load) == list(range(len(load)))
    assert negatives.groups_of_cells({}, 8) == []
    assert np.isclose(sum(load.values()), sum(cells.values()))
