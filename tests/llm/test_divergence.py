import re
from collections import Counter, defaultdict

import duckdb
import pytest

from chronolith.llm import divergence
from chronolith.llm.queries import ORACLE_SQL, QUERIES

from .awkward import empty, table


def plain(rows):
    """Every kept term against every source, in Python's integers."""
    langs = defaultdict(lambda: defaultdict(Counter))
    docs = defaultdict(Counter)
    for lang, source, text in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        langs[lang or ""][source or ""].update(terms)
        docs[lang or ""].update(set(terms))
    out = set()
    for lang, sources in langs.items():
        kept = [t for t, n in docs[lang].items() if n >= 3]
        shares = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[u] for u in kept) + len(kept)) for t in kept}
        p, q = {s: shares(c) for s, c in sources.items()}, shares(sum(sources.values(), Counter()))
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            terms = sorted((-f(p[s][t], q[t]), t.encode()) for t in kept if sources[s][t] and p[s][t] > q[t])[:200]
            for part, found in (("pair", pairs), ("term", terms)):
                out.update((lang, s, part, item.decode(), -v, n) for n, (v, item) in enumerate(found, 1))
    return out


def as_rows(df):
    rows = [tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_equals_its_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    want = con.execute(f"select lang, source, part, item, value, rank from ({ORACLE_SQL['op11_source_divergence']})").fetchall()
    assert as_rows(QUERIES["op11_source_divergence"](spark, sf_dir)) == set(want) and want


def test_query_equals_plain_integers(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert as_rows(QUERIES["op11_source_divergence"](spark, sf)) == plain([(r.lang, r.source, r.text) for r in docs])


def test_awkward_rows(spark):
    df = table(spark)
    assert as_rows(divergence.audit(df)) == plain([(r.lang, r.source, r.text) for r in df.collect()])
    assert divergence.audit(empty(spark)).count() == 0


def test_ties_groups_without_terms_and_repeats(spark):
    rows = [("en", s, t) for s in "abcd" for t in ("One one TWO", "one two three", "É é É")] + [("en", "none", None), ("en", None, "12 ."), (None, "x", "a b"), (None, "y", "a b"), ("fr", "alone", "un un un"), ("fr", "alone", "un"), ("fr", "alone", "un")]
    df = spark.createDataFrame([(*r, 1, "p", 7) for r in rows], "lang string, source string, text string, place int, sides string, n int")
    got = as_rows(divergence.audit(df))
    assert got == plain(rows)
    assert {r[4] for r in got if r[0] == ""} == {0} and ("en", "none", "pair") in {r[:3] for r in got}
    as_shuffled = as_rows(divergence.audit(df.repartition(7)))
    assert as_shuffled == got


def test_without_broadcasts(spark, monkeypatch, sf):
    monkeypatch.setattr(divergence, "FEW_GROUPS", 0)
    want = as_rows(QUERIES["op11_source_divergence"](spark, sf))
    monkeypatch.undo()
    assert as_rows(QUERIES["op11_source_divergence"](spark, sf)) == want


def test_counts_beyond_a_double(spark):
    big = spark.createDataFrame([(10**16 + 7, 3 * 10**16 + 11, 5)], "n long, total long, kept long")
    assert big.select(divergence.share(*map(divergence.F.col, ("n", "total", "kept")))).first()[0] == 1 + 10**9 * (10**16 + 8) // (3 * 10**16 + 16)


def test_pairs_are_made_in_the_jvm_and_summed_before_the_shuffle(spark, sf):
    plan = QUERIES["op11_source_divergence"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "partial_sum(" in plan and "WindowGroupLimit" in plan


def test_counts_handed_on_in_parts(spark, monkeypatch, sf):
    want = as_rows(QUERIES["op11_source_divergence"](spark, sf))
    monkeypatch.setattr(divergence, "TERMS_AHEAD", 5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    assert as_rows(QUERIES["op11_source_divergence"](spark, sf)) == want
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
