"""Quality rules over pages: one pass of columns for what a page shows by itself, joins for what needs other pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolith.functions import text as T
from chronolith.functions.plugins import frontmatter_kinds

from . import pages as P
from .order import saved

#: What the rules allow.
TYPES = ("entity", "concept", "source", "synthesis", "decision", "log", "index")
ENTITY_STATUSES = ("live", "degraded", "dormant", "retired", "broken", "candidate", "not-installed", "legacy")
DECISION_STATUSES = ("undecided", "decided", "superseded")
LENGTH_CAPS = {"concept": 150, "entity": 250}
H1_EXEMPT = ("index", "log", "MEMORY")


def lines(content: Column) -> Column:
    return F.regexp_count(content, F.lit("\n")) + F.when(content.endswith("\n"), 0).otherwise(1)


def source_list(block: Column) -> Column:
    """The text of the frontmatter's sources: a list in brackets, or the `- ` lines below."""
    return F.regexp_extract(block, r"(?m)^sources:[ \t]*(\[.*\][ \t]*$|\n(?:[ \t]*- .*\n?)+)", 1)


def own_rules() -> list[tuple[str, str, Column, Column]]:
    """(severity, rule, condition, msg) over path, name, block, body, type, status, lines, parsed."""
    kind, status, name, block = F.col("type"), F.col("status"), F.col("name"), F.col("block")
    h1 = F.trim(F.regexp_extract("body", r"(?m)^# (.+?)$", 1))
    date = lambda c: T.frontmatter_field(block, c)
    is_a = lambda c: F.try_element_at("parsed.kinds", F.lit(c))
    said = lambda c: F.coalesce(date(c), is_a(c))
    no_date = lambda c: is_a(c).isNotNull() & ~is_a(c).isin("date", "datetime") & ~((is_a(c) == "str") & F.coalesce(date(c), F.lit("")).rlike(r"^\d{4}-\d{2}-\d{2}$"))
    rest = F.regexp_extract("path", r"sources/notes/(.*)$", 1)
    nested = rest.rlike(r"^\d{4}/\d{2}/\d{2}/[^/]+/[^/]+$") & F.startswith(F.element_at(F.split(rest, "/"), -2), F.concat(F.translate(F.substring(rest, 1, 10), "/", "-"), F.lit("-")))
    cap = F.create_map(*[x for k, n in LENGTH_CAPS.items() for x in (F.lit(k), F.lit(n))])[F.coalesce(kind, F.lit(""))]
    return [
        ("error", "h1", (h1 != "") & (h1 != name) & ~name.isin(*H1_EXEMPT) & ~P.is_archive(F.col("path")), F.concat(F.lit("filename != H1 "), h1)),
        ("warning", "type_missing", kind.isNull(), F.lit("type missing")),
        ("warning", "type", ~kind.isin(*TYPES), F.concat(F.lit("type "), kind)),
        ("warning", "status", ((kind == "entity") & ~status.isin(*ENTITY_STATUSES)) | ((kind == "decision") & ~status.isin(*DECISION_STATUSES)), F.concat(F.lit("status "), status)),
        ("info", "status_unused", kind.isin("concept", "synthesis", "source", "log", "index") & status.isNotNull(), F.concat(kind, F.lit(" pages take no status"))),
        *[("warning", c, no_date(c), F.concat(F.lit(f"{c} not a date: "), said(c))) for c in ("created", "updated")],
        ("warning", "sources", is_a("sources") != "list", F.concat(F.lit("sources not a list but "), is_a("sources"))),
        ("warning", "tags", ~is_a("tags").isin("list", "NoneType"), F.concat(F.lit("tags not a list but "), is_a("tags"))),
        ("warning", "decision_status", (kind == "decision") & status.isNull(), F.lit("decision page missing status")),
        ("warning", "superseded_by", (kind == "decision") & (status == "superseded") & T.frontmatter_field(block, "superseded-by").isNull(), F.lit("superseded decision should name its successor")),
        ("error", "nesting", P.is_source_note(F.col("path")) & ~nested, F.lit("mis-nested source note")),
        ("info", "length", (F.col("lines") > cap) & T.frontmatter_field(block, "length-exempt").isNull(), F.format_string("%d lines", F.col("lines"))),
    ]


def lint(pages: DataFrame) -> DataFrame:
    """pages(path, name, content, block, body, type, status, links) -> (severity, file, rule, msg). A page without
    frontmatter, or with one that does not parse, has that one issue only. Texts are read once: what the page shows by itself and its links go to a slim
    written table, which the link rules join."""
    rows = pages.withColumn("lines", lines(F.col("content"))).withColumn("parsed", frontmatter_kinds("block"))
    issue = lambda s, r, msg: F.struct(F.lit(s).alias("severity"), F.lit(r).alias("rule"), msg.alias("msg"))
    own = [F.when(F.coalesce(on, F.lit(False)), issue(s, r, msg)) for s, r, on, msg in own_rules()]
    of = lambda c: F.coalesce(F.col(f"parsed.{c}"), F.array().cast("array<struct<text:string,kind:string>>"))
    tags = F.transform(F.filter(of("tags"), lambda t: t["kind"] == "str"), lambda t: t["text"])
    no_string = lambda c, rule: F.transform(F.filter(of(c), lambda t: t["kind"] != "str"), lambda t: issue("warning", rule, F.concat(F.lit(f"{c} entry not a string but "), t["kind"], F.lit(": "), t["text"])))
    tag_rules = F.concat(
        F.transform(F.filter(tags, lambda t: t != F.lower(t)), lambda t: issue("warning", "tag_case", F.concat(F.lit("tag "), t))),
        F.transform(F.filter(tags, lambda t: F.contains(t, F.lit(" "))), lambda t: issue("warning", "tag_blank", F.concat(F.lit("tag "), t))),
        no_string("tags", "tag_string"), no_string("sources", "source_string"),
    )
    none = F.array(issue("error", "frontmatter", F.lit("no frontmatter")))
    wrong = F.array(issue("error", "frontmatter_parse", F.concat(F.lit("frontmatter does not parse: "), F.col("parsed.error"))))
    found = F.when(F.col("block").isNull(), none).when(F.col("parsed.error").isNotNull(), wrong).otherwise(F.concat(F.filter(F.array(*own), lambda x: x.isNotNull()), tag_rules))
    linking = F.col("block").isNotNull() & F.col("parsed.error").isNull() & ~P.is_source_note(F.col("path"))
    all_links = F.array_union("links", T.wikilinks(F.coalesce(source_list(F.col("block")), F.lit(""))))
    slim = saved(rows.select("path", "name", found.alias("found"), F.when(linking, all_links).otherwise(F.array().cast("array<string>")).alias("links")))
    single = slim.select(F.col("path").alias("file"), F.inline("found")).select("severity", "file", "rule", "msg")
    named = P.link_problems(slim).join(slim.select(F.col("name").alias("src"), F.col("path").alias("file")), "src")
    broken = F.col("problem") == "broken"
    msg = F.when(broken, F.concat(F.lit("broken wikilink: "), F.col("target"))).otherwise(F.concat(F.lit("case mismatch: "), F.col("target"), F.lit(" should be "), F.col("expected")))
    linked = named.select(F.when(broken, "error").otherwise("warning").alias("severity"), "file", F.when(broken, "link").otherwise("link_case").alias("rule"), msg.alias("msg"))
    return single.unionByName(linked)


def summary(issues: DataFrame) -> DataFrame:
    """One row: errors, warnings, infos, exit_code (1 with errors, else 2 with warnings, else 0)."""
    n = lambda s: F.count_if(F.col("severity") == s)
    return issues.agg(n("error").alias("errors"), n("warning").alias("warnings"), n("info").alias("infos")).select("*", F.when(F.col("errors") > 0, 1).when(F.col("warnings") > 0, 2).otherwise(0).alias("exit_code"))
