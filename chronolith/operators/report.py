"""Index, distill and log rotation as ordered lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolith.functions import text as T

from . import pages as P
from .order import numbered, saved


def entry(prefix: Column) -> Column:
    text = F.trim(F.coalesce("description", F.lit("")))
    return F.when(text != "", F.concat(prefix, F.lit(" — "), text)).otherwise(prefix)


def index_lines(pages: DataFrame, categories: tuple[str, ...] = ()) -> DataFrame:
    """(section, category, ord, line): entities by category (the given order, others by name, then uncategorised),
    concepts, syntheses, decisions with status, and sources by month, newest first."""
    # pages are read once, and what is said of each is reckoned once: conditions over it would repeat its expressions
    pages = saved(pages.select("name", "path", "type", "category", "status", "created", "description"))
    link = F.concat(F.lit("- [["), F.col("name"), F.lit("]]"))
    order = F.array(*map(F.lit, categories)) if categories else F.array().cast("array<string>")
    at = F.array_position(order, F.col("category"))
    slot = F.when(F.coalesce("category", F.lit("")) == "", 10_000).when(at > 0, at).otherwise(5_000)
    kind, sections = F.col("type"), {"entity": 1, "concept": 2, "synthesis": 3, "decision": 4, "source": 5}
    section = F.coalesce(*[F.when(kind == t, n) for t, n in sections.items()])
    prefix = F.when(kind == "decision", F.concat(link, F.lit(" **["), F.coalesce("status", F.lit("?")), F.lit("]**"))).otherwise(link)
    said = pages.where(kind.isin(*sections)).select(
        section.alias("section"), F.when(kind == "entity", slot).otherwise(0).cast("long").alias("slot"), F.when(kind == "entity", F.coalesce("category", F.lit("Uncategorized"))).alias("category"),
        F.when(kind != "source", F.lower("name")).alias("key"), F.when(kind != "source", entry(prefix)).alias("line"), F.when(kind == "source", month()).alias("month"),
    )
    rows = said.where("section < 5").drop("month")
    counts = said.where("section = 5").groupBy("month").agg(F.count("*").alias("n"))
    months = counts.select(F.lit(5).alias("section"), (-F.row_number().over(Window.orderBy("month"))).cast("long").alias("slot"), F.lit(None).cast("string").alias("category"), F.lit("").alias("key"), F.format_string("- **%s** — %d sources", "month", "n").alias("line"))
    lines = rows.unionByName(months).withColumn("named", F.coalesce("category", F.lit("")))
    placed = numbered(lines, "section", "slot", "named", "key", "line")
    first = placed.groupBy("section").agg(F.min("number").alias("first"))  # five rows
    return placed.join(F.broadcast(first), "section").select("section", "category", (F.col("number") - F.col("first") + 1).alias("ord"), "line")


def month() -> Column:
    return T.month_key(F.col("created"), P.stem(F.col("path")), F.col("name"))


def by_month(pages: DataFrame) -> DataFrame:
    """(month, n) of source pages."""
    return pages.where("type = 'source'").groupBy(month().alias("month")).agg(F.count("*").alias("n"))


def by_type(pages: DataFrame) -> DataFrame:
    return pages.groupBy("type", F.coalesce("category", F.lit("Uncategorized")).alias("category")).agg(F.count("*").alias("n"))


def render(lines: DataFrame) -> DataFrame:
    """One text of all lines in order: an index is bounded by the number of pages, and only its writer asks for it."""
    return lines.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", "ord", "line"))), lambda s: s.line), "\n").alias("text"))


def stale(rendered: DataFrame, stored: DataFrame) -> DataFrame:
    return rendered.crossJoin(stored.select(F.col("text").alias("stored"))).select((F.col("text") != F.col("stored")).cast("int").alias("exit_code"))


def path_changes(changes: DataFrame, chronological: bool = False) -> DataFrame:
    """changes(seq, status, path) -> (path, first, last). The change log is newest first, and its order is kept as it
    is unless chronological."""
    first, last = (F.max_by, F.min_by) if chronological else (F.min_by, F.max_by)
    return changes.groupBy("path").agg(first("status", "seq").alias("first"), last("status", "seq").alias("last"))


def distill(changes: DataFrame, types: DataFrame, chronological: bool = False) -> DataFrame:
    """(kind, type, n): assets, deleted, added and modified pages by type. types(path, type)."""
    c = path_changes(changes, chronological).join(types, "path", "left")
    asset = F.col("path").startswith("wiki/assets/")
    kept = c.where(asset | (F.col("path").endswith(".md") & ~P.is_skipped(F.col("path"))))
    kind = F.when(asset, "asset").when(F.col("last") == "D", "deleted").when(F.col("first") == "A", "added").otherwise("modified")
    label = F.when(kind.isin("asset", "deleted"), F.lit(None).cast("string")).otherwise(F.coalesce("type", F.lit("(unknown)")))
    return kept.groupBy(kind.alias("kind"), label.alias("type")).agg(F.count("*").alias("n"))


def week(date: Column) -> Column:
    return F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), date), F.extract(F.lit("WEEK"), date))


def rotate(entries: DataFrame, today: Column, days: int = 14) -> DataFrame:
    """entries(date text, seq, text) -> (target, ord, …): live within `days`, older ones to their ISO week's archive,
    invalid dates to quarantine (they are kept, not dropped); newest first."""
    date = F.try_to_date("date", "yyyy-MM-dd")
    target = F.when(date.isNull(), "quarantine").when(date >= F.date_sub(today, days), "live").otherwise(week(date))
    w = Window.partitionBy("target").orderBy(F.desc("date"), "seq")
    return entries.withColumn("target", target).withColumn("ord", F.row_number().over(w))


def archives(entries: DataFrame, archived: DataFrame, today: Column, days: int = 14) -> DataFrame:
    """What the archives of the weeks that get something hold after a rotation: entries(date text, seq, text) older than `days`
    join archived(week, date text, seq, text) of their week -> (week, ord, date, seq, text, moved), newest first; of one day
    the newly moved stand before what was there, each in its own order. Weeks that get nothing are left alone, and so have no
    row. Each week is one file and one group."""
    aged = rotate(entries, today, days).where(~F.col("target").isin("live", "quarantine")).select(F.col("target").alias("week"), "date", "seq", "text", F.lit(True).alias("moved"))
    there = archived.join(aged.select("week").distinct(), "week", "left_semi").select("week", "date", "seq", "text", F.lit(False).alias("moved"))
    w = Window.partitionBy("week").orderBy(F.desc("date"), F.desc("moved"), "seq")
    return aged.unionByName(there).select("week", F.row_number().over(w).alias("ord"), "date", "seq", "text", "moved")


def archive_texts(merged: DataFrame) -> DataFrame:
    """(week, text): each archive as a page of type log, its entries in order."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "date", "text"))), lambda e: F.concat(F.lit("## ["), e["date"], F.lit("] "), e["text"])), "\n\n")
    return merged.groupBy("week").agg(body.alias("body")).select("week", F.concat(F.lit("---\ntype: log\n---\n\n# log "), "week", F.lit("\n\n"), "body", F.lit("\n")).alias("text"))


def last_distill(pages: DataFrame) -> Column | None:
    """The day of the newest page named distill-<day>, null if there is none, as a literal."""
    day = F.try_to_date(F.regexp_extract("name", r"^distill-(\d{4}-\d{2}-\d{2})$", 1), "yyyy-MM-dd")
    return F.lit(pages.agg(F.max(day)).first()[0]).cast("date")


def since_last(changes: DataFrame, pages: DataFrame) -> DataFrame:
    """The changes(…, at) from the day of the last distill on; all of them before the first."""
    bound = last_distill(pages)
    return changes.where(bound.isNull() | (F.col("at").cast("date") >= bound))


def distill_text(counts: DataFrame, day: Column) -> DataFrame:
    """One text of distill's counts (kind, type, n): a heading for each kind, its types by number."""
    line = F.concat(F.lit("- "), F.coalesce("type", F.lit("pages")), F.lit(": "), F.col("n").cast("string"))
    parts = counts.groupBy("kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("by"), line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))
    block = F.concat(F.lit("## "), "kind", F.lit("\n\n"), "lines")
    return parts.agg(F.concat(F.lit("# distill "), F.date_format(day, "yyyy-MM-dd"), F.lit("\n\n"), F.array_join(F.array_sort(F.collect_list(block)), "\n\n"), F.lit("\n")).alias("text"))


def per_week(entries: DataFrame) -> DataFrame:
    return entries.where(F.try_to_date("date", "yyyy-MM-dd").isNotNull()).groupBy(week(F.try_to_date("date", "yyyy-MM-dd")).alias("week")).agg(F.count("*").alias("n"))
