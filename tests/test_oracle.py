"""Every query with SQL against DuckDB on the same tables, as rows in any order."""

import glob
import math
import os

import duckdb
import pytest

from chronolith.operators import status
from chronolith.plans import catalog


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return f"{float(v):.6g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(cell, v)) + "]"
    return str(v)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}{'/*' if os.path.isdir(path) else ''}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, sf, duck, name):
    got, want = catalog.QUERIES[name](spark, sf), duck.execute(catalog.ORACLE_SQL[name])
    names = sorted(d[0] for d in want.description)
    assert sorted(got.columns) == names
    at = [[d[0] for d in want.description].index(n) for n in names]
    left = sorted(tuple(cell(r[n]) for n in names) for r in got.collect())
    right = sorted(tuple(cell(r[k]) for k in at) for r in want.fetchall())
    assert len(left) == len(right), (len(left), len(right))
    wrong = [(a, b) for a, b in zip(left, right) if a != b]
    assert not wrong, wrong[:3]


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_query_without_sql_runs(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() >= 0


@pytest.mark.parametrize("name", ["status_gauges", "status_alerts"])
def test_statuses_of_null_keys_equal_sql(spark, tmp_path, name):
    """What a status does not say is null to its SQL."""
    con = duckdb.connect()
    con.execute("create view customer as select case when i % 5 <> 3 then i end as c_custkey from range(60) t(i)")
    con.execute(f"copy customer to '{tmp_path}/customer.parquet' (format parquet)")
    rows = lambda found: sorted(tuple(map(cell, r)) for r in found)
    want = con.execute(catalog.ORACLE_SQL[name])
    assert rows(catalog.QUERIES[name](spark, str(tmp_path)).select(*[d[0] for d in want.description]).collect()) == rows(want.fetchall())


def test_gauges_of_an_empty_status_are_those_of_the_reference(spark):
    """By themselves gauges and alerts take what is not there for 0 and not ready."""
    c = "wiki_ready boolean, degraded boolean, graph_ready boolean, git_ready boolean, ingest_error string, pages_indexed long, index_age long, inbox long, deferred long, blocked long, review long, pending long, partial long, lag_seconds long, community_age long, community_count long"
    none = spark.createDataFrame([(None,) * 16], c)
    assert {r.name: r.value for r in status.gauges(none).collect() if r.value} == {"wiki_index_age_seconds": math.inf}
    assert sorted(r.rule for r in status.alerts(none).collect()) == ["git_ready", "graph_ready", "no_communities", "wiki_ready"]
