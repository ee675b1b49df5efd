"""Query-log analytics: usage, answer health, gaps, histograms and sliding rates.

events(ts timestamp, tool, outcome, confidence, cached, grounded, error, test, query, n, score, duration_ms, …)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronolith.functions import text as T

LOW_SCORE = 0.45
CONFIDENCES = ("high", "medium", "low", "not_found", "error")
OUTCOMES = ("ok", "error", "not_found", "degraded")
BOUNDS = (0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0)


def literal(spark: SparkSession, column: str, values: tuple) -> DataFrame:
    return F.broadcast(spark.createDataFrame([(v,) for v in values], f"{column} string"))


def real(events: DataFrame) -> DataFrame:
    return events.where(T.real_traffic(F.col("test")))


def failed() -> Column:
    blank = F.lit("")
    return (F.coalesce("confidence", blank) == "error") | (F.coalesce("outcome", blank) == "error") | (F.coalesce("error", blank) != "")


def by_tool(events: DataFrame) -> DataFrame:
    """(tool, calls, errors, cache_hits); an unknown tool is other."""
    tool = F.when(F.col("tool").isin(*T.TOOLS), F.col("tool")).otherwise("other")
    return real(events).groupBy(tool.alias("tool")).agg(F.count("*").alias("calls"), F.count_if(failed()).alias("errors"), F.count_if(F.col("cached")).alias("cache_hits"))


def by_confidence(events: DataFrame) -> DataFrame:
    """(confidence, n) with every confidence."""
    seen = real(events).groupBy("confidence").count()
    return literal(events.sparkSession, "confidence", CONFIDENCES).join(seen, "confidence", "left").select("confidence", F.coalesce("count", F.lit(0)).alias("n"))


def answer_health(events: DataFrame) -> DataFrame:
    """One row: calls, cache_hits, median answer and packet tokens, compression, not_found_rate."""
    answers = real(events).where(F.col("tool") == "graph_answer")
    good = F.col("confidence").isin("high", "medium", "low") & (F.coalesce("answer_tokens", F.lit(0)) > 0)
    row = answers.agg(
        F.count("*").alias("calls"), F.count_if("cached").alias("cache_hits"), F.median(F.when(good, F.col("answer_tokens"))).alias("median_answer"),
        F.median(F.when(good, F.coalesce("packet_tokens", F.lit(0)))).alias("median_packet"), F.count_if(F.col("confidence").isin("not_found", "error")).alias("lost"),
    )
    return row.select("calls", "cache_hits", "median_answer", "median_packet", F.bround(F.try_divide("median_packet", "median_answer"), 1).alias("compression"), F.bround(F.try_divide("lost", "calls"), 3).alias("not_found_rate"))


def usage_split(events: DataFrame) -> DataFrame:
    """One row of call counts by tool; test traffic of the wiki tools counts, that of the graph tools does not."""
    mine = lambda t, test: F.count_if((F.col("tool") == t) & (T.real_traffic(F.col("test")) if test else F.lit(True)))
    return events.agg(*[mine(t, t.startswith("graph_")).alias(f"{t}_calls") for t in ("wiki_search", "wiki_get", "graph_search", "graph_answer", "graph_entity")])


def gaps(events: DataFrame) -> DataFrame:
    """(src, key, q, best_score): questions that found nothing useful, one for each normalised key of 60 code points,
    the first in the order wiki, graph, answer and time."""
    wiki = events.where((F.col("tool") == "wiki_search") & ((F.coalesce("n", F.lit(0)) == 0) | (F.coalesce("score", F.lit(0.0)) < LOW_SCORE)))
    graph = real(events).where((F.col("tool") == "graph_search") & (F.coalesce("n", F.lit(0)) == 0))
    lost = real(events).where((F.col("tool") == "graph_answer") & F.col("confidence").isin("not_found", "error"))
    part = lambda df, n, src, score: df.select(F.lit(n).alias("part"), F.lit(src).alias("src"), "ts", "event_id", F.col("query").alias("q"), score.alias("best_score"))
    none = F.lit(None).cast("double")
    rows = part(wiki, 0, "wiki", F.bround(F.coalesce("score", F.lit(0.0)), 3)).unionByName(part(graph, 1, "graph", none)).unionByName(part(lost, 2, "answer", none))
    keyed = rows.withColumn("key", F.substring(T.squeeze(F.lower("q")), 1, 60)).where("key <> ''")
    first = F.min_by(F.struct("src", "q", "best_score"), F.struct("part", "ts", "event_id"))
    return keyed.groupBy("key").agg(first.alias("f")).select("f.src", "key", "f.q", "f.best_score")


def recurring(gap_rows: DataFrame, prior: DataFrame, most: int = 64_000_000) -> DataFrame:
    """Gaps whose first 40 code points stand in a prior report's text. prior(text) is a stated set of reports: they are
    broadcast if they have at most `most` bytes, and each gap is looked for in each."""
    key = F.substring(T.squeeze(F.lower("q")), 1, 40)
    reports = prior.select(F.lower("text").alias("prior_text"))
    if (reports.agg(F.sum(F.octet_length("prior_text"))).first()[0] or 0) <= most:
        reports = F.broadcast(reports)
    return gap_rows.join(reports, F.contains(F.col("prior_text"), key), "left_semi")


def recurring_by_seeds(gap_rows: DataFrame, prior: DataFrame, seed: int = 8) -> DataFrame:
    """The same rows as `recurring` for reports of any number and size, as an equi-join: the first `seed` code points of a
    gap's key, all of a shorter one, meet the windows of the reports that begin with them, and a window's text verifies the
    key. A report's equal windows count once before they are shuffled. An empty key stands in every report."""
    key = F.substring(T.squeeze(F.lower("q")), 1, 40)
    keyed = gap_rows.withColumn("gap_key", key).withColumn("seed", F.substring("gap_key", 1, seed))
    text = F.lower("text")
    windows = prior.where("text is not null").select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), lambda i: F.substring(text, i, F.lit(40)))).alias("window")).distinct()
    lengths = [r[0] for r in keyed.select(F.length("seed")).distinct().collect()]  # at most `seed` + 1 numbers
    starts = windows.select("window", F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.substring("window", 1, n).alias("seed")) for n in lengths] or [F.struct(F.lit(0).alias("n"), F.lit("").alias("seed"))])).alias("s"))
    met = starts.where(F.length("s.seed") == F.col("s.n")).select(F.col("s.seed").alias("seed"), "window")
    return keyed.join(met, (keyed.seed == met.seed) & F.startswith("window", "gap_key"), "left_semi").drop("gap_key", "seed")


def triggers(events: DataFrame, gap_rows: DataFrame, recurring_rows: DataFrame) -> DataFrame:
    """One row: which builds the week's use warrants."""
    searches = real(events).where(F.col("tool") == "graph_search").agg(F.count("*").alias("graph_searches"))
    zero = gap_rows.agg(F.count_if(F.col("src") == "graph").alias("zero_hits"))
    again = recurring_rows.agg(F.count("*").alias("recurring"))
    return searches.crossJoin(zero).crossJoin(again).select("*", (F.col("graph_searches") >= 200).alias("learned_ranking"), (F.col("recurring") >= 5).alias("gap_classifier"), (F.col("zero_hits") >= 15).alias("episode_embeddings"))


def most_fetched(events: DataFrame, limit: int = 10) -> DataFrame:
    return events.where(F.col("tool") == "wiki_get").groupBy(F.col("query").alias("name")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(limit)


def counters(events: DataFrame) -> DataFrame:
    """(tool, outcome, n) over all known tools and outcomes, zero where nothing happened."""
    spark = events.sparkSession
    grid = literal(spark, "tool", (*T.TOOLS, "other")).crossJoin(literal(spark, "outcome", OUTCOMES))
    seen = events.groupBy(T.tool_name(F.lit(None).cast("string"), F.col("tool")).alias("tool"), T.outcome(F.col("outcome"), F.col("confidence"), F.col("error")).alias("outcome")).count()
    return grid.join(seen, ["tool", "outcome"], "left").select("tool", "outcome", F.coalesce("count", F.lit(0)).alias("n"))


def durations(events: DataFrame, *key: str) -> DataFrame:
    """(*key, calls, p50, p95) exact."""
    return events.groupBy(*key).agg(F.count("*").alias("calls"), F.percentile("duration_ms", 0.5).alias("p50"), F.percentile("duration_ms", 0.95).alias("p95"))


def histogram(events: DataFrame, *key: str, bounds: tuple = BOUNDS) -> DataFrame:
    """(*key, le, n): cumulative buckets of duration in seconds, +Inf last, one pass over the events."""
    seconds = F.col("duration_ms") / 1000
    counts = [F.count_if(seconds <= b).alias(str(i)) for i, b in enumerate(bounds)]
    wide = events.groupBy(*key).agg(*counts, F.count("duration_ms").alias(str(len(bounds))))
    pairs = F.array(*[F.struct(F.lit(le).alias("le"), F.col(f"`{i}`").alias("n")) for i, le in enumerate([*map(str, bounds), "+Inf"])])
    return wide.select(*key, F.inline(pairs))


def rolling_rate(events: DataFrame, seconds: int = 600, least: int = 20, threshold: float = 0.05) -> DataFrame:
    """Adds calls, bad and alert over the last `seconds` up to each event, by tool: a range frame within pieces of that
    length, each with the piece before it, so that a tool's whole history is not one group."""
    piece = F.floor(F.unix_seconds("ts") / seconds)
    rows = events.withColumn("failed", failed().cast("int")).withColumn("piece", F.explode(F.array(piece, piece + 1))).withColumn("own", F.col("piece") == piece)
    w = Window.partitionBy("tool", "piece").orderBy(F.unix_seconds("ts")).rangeBetween(-seconds, 0)
    rows = rows.withColumn("calls", F.count("*").over(w)).withColumn("bad", F.sum("failed").over(w)).where("own").drop("failed", "piece", "own")
    return rows.withColumn("alert", (F.col("calls") >= least) & (F.col("bad") / F.greatest("calls", F.lit(0.001)) > threshold))


def windowed(events: DataFrame, width: str, slide: str | None = None) -> DataFrame:
    """(start, tool, outcome, n) over tumbling or sliding windows; the same for streams."""
    win = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.groupBy(win.alias("w"), "tool", "outcome").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "tool", "outcome", "n")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    return events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")
