"""Document catalog and link graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolith.functions import text as T


def parts(path: Column) -> Column:
    return F.split(path, "/")


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(parts(path), -1), r"\.[^.]*$", "")


def parent(path: Column) -> Column:
    return F.try_element_at(parts(path), F.lit(-2))


def is_source_note(path: Column) -> Column:
    return path.rlike(r"(^|/)sources/notes/")


def is_skipped(path: Column) -> Column:
    """README.md anywhere; below sources/notes all but <slug>/<slug>.md."""
    note = is_source_note(path)
    return (F.element_at(parts(path), -1) == "README.md") | (note & (~path.endswith(".md") | ~stem(path).eqNullSafe(parent(path))))


def is_archive(path: Column) -> Column:
    """Rotated logs and dated distills."""
    return (F.array_contains(parts(path), "log") & stem(path).rlike(r"^\d{4}-(W\d{2}|\d{2})$")) | (F.array_contains(parts(path), "distill") & stem(path).rlike(r"^\d{4}-\d{2}-\d{2}$"))


def catalog(files: DataFrame) -> DataFrame:
    """files(path, content) -> one page for each name: of equal names the lowest path wins."""
    pages = files.where(~is_skipped(F.col("path"))).select("path", "content", stem(F.col("path")).alias("name"))
    first = pages.withColumn("rn", F.row_number().over(Window.partitionBy("name").orderBy("path"))).where("rn = 1").drop("rn")
    return first.withColumns({
        "block": T.frontmatter(F.col("content")), "body": T.body(F.col("content")),
    }).withColumns({
        "type": T.frontmatter_field(F.col("block"), "type"), "category": T.frontmatter_field(F.col("block"), "category"), "status": T.frontmatter_field(F.col("block"), "status"),
        "description": F.coalesce(T.frontmatter_field(F.col("block"), "index-description"), T.first_paragraph(F.col("content"))), "body_hash": T.short_hash(F.col("body")), "links": T.wikilinks(F.col("body")),
    })


def links(pages: DataFrame) -> DataFrame:
    """(src, dst) of links whose target exists, in exact case; self-links stay."""
    out = pages.select(F.col("name").alias("src"), F.explode("links").alias("dst"))
    return out.join(pages.select(F.col("name").alias("dst")), "dst", "left_semi").select("src", "dst")


def backlinks(pages: DataFrame, name: str) -> DataFrame:
    """(name, backlinks): no row if the page is missing, an empty array if nothing links to it."""
    inbound = links(pages).where(F.col("dst") == name).groupBy("dst").agg(F.sort_array(F.collect_set("src")).alias("backlinks"))
    return pages.where(F.col("name") == name).select("name").join(inbound, F.col("name") == F.col("dst"), "left").select("name", F.coalesce("backlinks", F.array().cast("array<string>")).alias("backlinks"))


def page(pages: DataFrame, name: str) -> DataFrame:
    """The page's row with sorted wikilinks_out and wikilinks_in; no row if it is missing."""
    return pages.where(F.col("name") == name).withColumn("wikilinks_out", F.sort_array("links")).join(backlinks(pages, name).withColumnRenamed("backlinks", "wikilinks_in"), "name")


def link_problems(pages: DataFrame) -> DataFrame:
    """(src, target, problem, expected): broken if no name equals the target in any case, case if only the case differs."""
    found = pages.select(F.col("name").alias("src"), F.explode("links").alias("target")).withColumn("low", F.lower("target"))
    names = pages.groupBy(F.lower("name").alias("low")).agg(F.max("name").alias("expected"))
    broken = found.join(names, "low", "left_anti").select("src", "target", F.lit("broken").alias("problem"), F.lit(None).cast("string").alias("expected"))
    case = found.join(names, "low").where("expected <> target").select("src", "target", F.lit("case").alias("problem"), "expected")
    return broken.unionByName(case)


def reindex(pages: DataFrame, cache: DataFrame) -> DataFrame:
    """pages(name, hash, legacy_hash) against cache(name, hash, hash_format) -> (name, action): reuse on the exact hash,
    migrate on the old format's, embed otherwise, remove what is cached only."""
    c = cache.select("name", F.col("hash").alias("cached"), "hash_format")
    both = pages.join(c, "name", "full_outer")
    action = (
        F.when(F.col("hash").isNull(), "remove")
        .when((F.col("hash_format") == "embedding-input-v1") & (F.col("cached") == F.col("hash")), "reuse")
        .when((F.col("hash_format") == "legacy-body-v0") & (F.col("cached") == F.col("legacy_hash")), "migrate")
        .otherwise("embed")
    )
    return both.select("name", action.alias("action"))


def readiness(state: DataFrame) -> DataFrame:
    """state(usable, omitted, error) -> (ready, degraded, state): a failure keeps a usable index, degraded."""
    usable, bad = F.col("usable") > 0, F.col("error").isNotNull() | (F.col("omitted") > 0)
    label = F.when(usable & bad, "degraded").when(usable, "ready").when(F.col("error").isNotNull(), "error").otherwise("initializing")
    return state.select("*", usable.alias("ready"), (usable & bad).alias("degraded"), label.alias("state"))
