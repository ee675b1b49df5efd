"""Source divergence audit: how the term shares of a language's sources differ, in exact integers.

Terms are counted by (language, source); each term's counts then form one wide vector, whose slots are the sources of its
language by number. Slots of sources without the term are left out of the vector, as they hold the same share for all terms
(`floor`), and vectors that are equal are counted, not repeated. Higher-order functions turn a vector into its pairs of sources,
generated code reckons what its terms add to each, and sums by pair are combined on the map side.

For a pair (s, t) the sum over all kept terms is taken as
    terms of s against t's floor + s's floor against terms of t + (all - of s - of t) * floor against floor
    + for terms of both: what they add, less what the first two took them for, plus floor against floor,
so that a term costs the square of the sources that have it, not of all sources.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, byte_column, give_back

#: What a term is made of, in UTF-8: ASCII letters and everything beyond ASCII.
TERM = rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Terms that a task counts before it hands them on.
TERMS_AHEAD = 60_000
SCALE = 1_000_000_000
#: Groups (language, source) up to which their table, a number or two for each, is broadcast; they are counted.
FEW_GROUPS = 200_000


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + kept)), exact for counts of 18 digits."""
    up = (count + 1).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.call_function("div", up, (total + kept).cast("decimal(19,0)")) + 1


def excess(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q)"""
    return F.call_function("div", (p - q) * (p - q), q)


def counted_terms(rows: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of rows(lang, source, text): occurrences, and rows that have the term. Tasks count ahead,
    by group, and hand on what they have whenever it comes to many terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        term, held = re.compile(TERM), 0
        told: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def counts():
            for (lang, source), (n, docs) in told.items():
                size = len(n)
                cols = [pa.array([lang] * size, pa.string()), pa.array([source] * size, pa.string()), pa.array(n, pa.binary()), pa.array(n.values(), pa.int64()), pa.array(map(docs.get, n), pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["lang", "source", "term", "n", "docs"])
            told.clear()

        for b in batches:
            for lang, source, text in zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), byte_column(b, "text")):
                found = term.findall(text.lower())  # bytes: only A-Z change
                n, docs = told.setdefault((lang, source), (Counter(), Counter()))
                known = len(n)
                n.update(found)
                docs.update(set(found))
                held += len(n) - known
                if held > TERMS_AHEAD:
                    yield from counts()
                    held = 0
        yield from counts()
        give_back()

    each = rows.select("lang", "source", F.col("text").cast("binary").alias("text")).mapInArrow(run, "lang string, source string, term binary, n long, docs long")
    return each.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def small(df: DataFrame, count: int) -> DataFrame:
    """A table of `count` groups, to be broadcast if these are few."""
    return F.broadcast(df) if count <= FEW_GROUPS else df


def wide_vectors(counts: DataFrame, groups: DataFrame, n_groups: int, least_docs: int) -> DataFrame:
    """(lang, term, total, slots): the terms that stand in at least `least_docs` rows of their language; slots are the
    (source number, count) of the sources that have it, by number."""
    placed = counts.join(small(groups.select("lang", "source", "place"), n_groups), ["lang", "source"])
    vectors = placed.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.sort_array(F.collect_list(F.struct("place", "n"))).alias("slots"))
    return vectors.where(F.col("docs") >= least_docs).drop("docs")


def pair_sums(vectors: DataFrame, groups: DataFrame, langs: DataFrame, n_groups: int) -> DataFrame:
    """(lang, place, other, value) for each two sources of a language: the excess of place's shares over other's, summed
    over all kept terms."""
    # one row for each language: its groups by number, each with its floor, terms and total
    sides = langs.select("lang", "kept", "sides")
    floor = lambda k: F.get("sides", k)["floor"]
    others = lambda f: F.transform(F.filter("sides", lambda o: o["place"] != F.col("place")), f)
    pair = lambda a, b, value: F.struct(a.alias("place"), b.alias("other"), value.cast("long").alias("value"))

    # floors against floors, for the terms that neither has or that are set right below
    base = groups.select("lang", "place", "terms", "floor").join(small(sides, n_groups), "lang").select(
        "lang", F.explode(others(lambda o: pair(F.col("place"), o["place"], F.when(F.col("kept") > 0, (F.col("kept") - F.col("terms") - o["terms"]) * excess(F.col("floor"), o["floor"])).otherwise(0)))).alias("e")
    )
    # terms of one source against the floors of all others, and the other way round: equal counts have equal shares
    equal = vectors.select("lang", F.explode("slots").alias("s")).groupBy("lang", "s.place", "s.n").count()
    shares = equal.join(small(sides, n_groups), "lang").withColumn("p", share(F.col("n"), F.get("sides", F.col("place"))["total"], F.col("kept")))
    alone = shares.select(
        "lang", F.explode(F.flatten(others(lambda o: F.array(pair(F.col("place"), o["place"], F.col("count") * excess(F.col("p"), o["floor"])), pair(o["place"], F.col("place"), F.col("count") * excess(o["floor"], F.col("p"))))))).alias("e")
    )
    # terms that both have
    equal_vectors = vectors.where(F.size("slots") > 1).groupBy("lang", "slots").count()
    valued = equal_vectors.join(small(sides, n_groups), "lang").select(
        "lang", "count", F.transform("slots", lambda s: F.struct(s["place"].alias("place"), share(s["n"], F.get("sides", s["place"])["total"], F.col("kept")).alias("p"), floor(s["place"]).alias("floor"))).alias("slots")
    )
    # of the sources behind each one in its vector; both directions of a pair are reckoned in one row
    one = valued.select("lang", "count", "slots", F.explode("slots").alias("a"))
    behind = F.filter("slots", lambda b: b["place"] > F.col("a.place"))
    two = one.select("lang", "count", "a", F.explode(behind).alias("b"))
    adds = lambda a, b: F.col("count") * (excess(F.col(f"{a}.p"), F.col(f"{b}.p")) - excess(F.col(f"{a}.p"), F.col(f"{b}.floor")) - excess(F.col(f"{a}.floor"), F.col(f"{b}.p")) + excess(F.col(f"{a}.floor"), F.col(f"{b}.floor")))
    summed = two.groupBy("lang", F.col("a.place").alias("place"), F.col("b.place").alias("other")).agg(F.sum(adds("a", "b")).alias("there"), F.sum(adds("b", "a")).alias("back"))
    both = summed.select("lang", F.explode(F.array(pair(F.col("place"), F.col("other"), F.col("there")), pair(F.col("other"), F.col("place"), F.col("back")))).alias("e"))
    every = base.unionByName(alone).unionByName(both)
    return every.groupBy("lang", "e.place", "e.other").agg(F.sum("e.value").alias("value"))


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = 3, top_terms: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank). Part `pair` has, for each source of a language, all its other sources and by
    how much the first one's shares of the kept terms exceed theirs; part `term` the terms that a source has more often than
    its language, at most `top_terms` of them. Ranks are by value, the largest first, equal values by item in UTF-8 order.

    Null texts, languages and sources are empty ones; an empty text has no terms, but its group counts as one. Rows are rows:
    a repeated one counts again, and a term stands in a document as often as the row is repeated. A language whose terms all
    stand in fewer than `least_docs` rows keeps none, and its pairs have the value 0. Columns other than the three named are
    not read, an empty table gives no rows, and a very long text is counted in its own row. Sums fit a long up to a thousand
    million kept terms."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "divergence")
    given = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    rows = docs.select(given(lang_col).alias("lang"), given(source_col).alias("source"), given(text_col).alias("text"))
    found = rows.select("lang", "source").distinct()
    numbered = found.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)  # a row a source
    names = scratch.table(numbered, "names")
    n_groups = names.count()
    vectors = scratch.table(wide_vectors(counted_terms(rows), names, n_groups, least_docs), "vectors")

    kept = vectors.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("total").alias("lang_total"))
    totals = vectors.select("lang", F.explode("slots").alias("s")).groupBy("lang", "s.place").agg(F.count("*").alias("terms"), F.sum("s.n").alias("total"))
    filled = names.join(totals, ["lang", "place"], "left").join(kept, "lang", "left").fillna(0, ["terms", "total", "kept", "lang_total"])
    groups = scratch.table(filled.withColumn("floor", F.when(F.col("kept") > 0, share(F.lit(0).cast("long"), F.col("total"), F.col("kept"))).otherwise(1)), "groups")
    sides = F.sort_array(F.collect_list(F.struct("place", "source", "floor", "terms", "total"))).alias("sides")
    langs = scratch.table(groups.groupBy("lang").agg(F.first("kept").alias("kept"), F.first("lang_total").alias("lang_total"), sides), "langs")

    sums = pair_sums(vectors, groups, langs, n_groups)
    named = small(groups.select("lang", "place", "source"), n_groups)
    pairs = sums.join(named, ["lang", "place"]).join(named.select("lang", F.col("place").alias("other"), F.col("source").alias("item")), ["lang", "other"])
    by_rank = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pair_part = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(by_rank).alias("rank"))

    own = vectors.select("lang", "term", "total", F.explode("slots").alias("s")).select("lang", F.col("term").alias("item"), F.col("total").alias("all"), "s.place", "s.n")
    compared = own.join(small(groups.select("lang", "place", "source", "total", "kept", "lang_total"), n_groups), ["lang", "place"])
    above = compared.withColumn("p", share(F.col("n"), F.col("total"), F.col("kept"))).withColumn("q", share(F.col("all"), F.col("lang_total"), F.col("kept"))).where("p > q")
    term_part = above.select("lang", "source", F.lit("term").alias("part"), "item", excess(F.col("p"), F.col("q")).alias("value")).withColumn("rank", F.row_number().over(by_rank)).where(F.col("rank") <= top_terms)
    return pair_part.unionByName(term_part)
