"""Cumulative counters: increases and rates over sliding windows, quantiles of their histograms, and alert rules on them.

Samples are (labels…, at, value), at in seconds. A value below the one before it is a reset: the counter began again from
zero. Windows end at the multiples of a step and hold the samples after their start and up to their end."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import status
from .order import dealt, saved

#: A window's edge is reached if it is nearer than so many mean distances of samples; else half of one is added.
NEAR, REST = 1.1, 2
LOOKBACK = 300


def with_previous(pieces: DataFrame, labels: Sequence[str], width: int = 3600) -> DataFrame:
    """Adds before, the last sample of the same series' piece before. Long series are cut into parts of `width` pieces' places,
    so that none is a single group; what stands before a part is carried from a table with one row for each series and part."""
    rows = pieces.withColumn("part", F.floor(F.col("piece") / width))
    parts = rows.groupBy(*labels, "part").agg(F.max("last").alias("behind"))
    carried = parts.select(*labels, "part", F.lag("behind").over(Window.partitionBy(*labels).orderBy("part")).alias("carried"))
    own = F.lag("last").over(Window.partitionBy(*labels, "part").orderBy("piece"))
    return rows.withColumn("own", own).join(carried, [*labels, "part"]).withColumn("before", F.coalesce("own", "carried")).drop("own", "carried", "part")


def ends_of_windows(at: Column, window: int, step: int) -> Column:
    """The ends of the windows that a sample is in: multiples of the step from its time on, less than a window later."""
    first, behind = F.ceil(at / step), F.ceil((at + window) / step) - 1
    return F.when(first <= behind, F.transform(F.sequence(first, behind), lambda k: k * step))


def increases(samples: DataFrame, labels: Sequence[str], window: int, step: int, width: int = 3600) -> DataFrame:
    """(labels…, at, n, increase, rate): by how much a counter rose in the window that ends at `at`, resets undone, and per
    second. What the n samples show is extended to the window's edges: to an edge that is near, else by half of their mean
    distance, and back to no further than where the counter would have been zero. A window with fewer than two samples, or
    with all of them at one time, has no row. Null labels are ''; samples with a null time or value are left out; of samples
    of one series and time the larger counts as the later."""
    named = samples.where("at is not null and value is not null").select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in labels], F.col("at").cast("double").alias("at"), F.col("value").cast("double").alias("value"))
    grid = math.gcd(window, step)
    told = lambda at, value: F.struct(F.col(at).alias("at"), F.col(value).alias("value"))
    # the windows are made of pieces of the grid: within a piece samples are put in order once, and one row is left of it
    piece = dealt(named.withColumn("piece", F.ceil(F.col("at") / grid)), *labels, "piece")
    by = Window.partitionBy(*labels, "piece").orderBy("at", "value")
    fell = F.col("value") < F.lag("value").over(by)
    pieces = saved(piece.withColumn("undone", F.when(fell, F.lag("value").over(by)).otherwise(0.0)).groupBy(*labels, "piece").agg(
        F.count("*").alias("n"), F.min(told("at", "value")).alias("first"), F.max(told("at", "value")).alias("last"), F.sum("undone").alias("undone"),
    ))
    # a reset between two pieces counts in the windows that have the sample before it
    rows = with_previous(pieces, labels, width).withColumn("end", F.explode(ends_of_windows(F.col("piece") * grid, window, step)))
    reset = (F.col("first.value") < F.col("before.value")) & (F.col("before.at") > F.col("end") - window)
    seen = rows.groupBy(*labels, "end").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"), F.sum(F.col("undone") + F.when(reset, F.col("before.value")).otherwise(0.0)).alias("undone"))
    shown = seen.withColumn("span", F.col("last.at") - F.col("first.at")).where("n > 1 and span > 0").withColumn("rise", F.col("last.value") - F.col("first.value") + F.col("undone"))
    mean = F.col("span") / (F.col("n") - 1)
    reach = lambda gap: F.when(gap < mean * NEAR, gap).otherwise(mean / REST)
    to_start = reach(F.col("first.at") - (F.col("end") - window))
    to_zero = F.when((F.col("rise") > 0) & (F.col("first.value") >= 0), F.col("span") * F.col("first.value") / F.col("rise"))
    whole = F.col("span") + F.least(to_start, to_zero) + reach(F.col("end") - F.col("last.at"))
    out = shown.withColumn("increase", F.col("rise") * whole / F.col("span"))
    return out.select(*labels, F.col("end").alias("at"), "n", "increase", (F.col("increase") / window).alias("rate"))


def histogram_quantile(buckets: DataFrame, by: Sequence[str], quantile: float) -> DataFrame:
    """(by…, value) of buckets(by…, le, n): n is cumulative up to the bound le, infinity last. Within a bucket values are
    taken to lie evenly; the first bucket begins at zero if its bound is above, the last bound stands for what is beyond it.
    Equal bounds are added up, and counts that fall, as rates of single scrapes may, are levelled up. Without an infinite
    bound, with fewer than two bounds, or without observations the value is NaN; below 0 and above 1 it is infinite.
    A group has as many rows as bounds."""
    sums = buckets.where("le is not null").groupBy(*by, "le").agg(F.sum("n").alias("n"))
    rising = F.max("n").over(Window.partitionBy(*by).orderBy("le").rowsBetween(Window.unboundedPreceding, 0))
    held = sums.withColumn("n", rising).groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("le", "n"))).alias("b"))
    size, total = F.size("b"), F.element_at("b", -1)["n"]
    rank = total * quantile
    # the last bucket holds what all before it do not
    at = F.array_position(F.transform(F.slice("b", F.lit(1), size - 1), lambda x: x["n"] >= rank), True).cast("int")
    hit, below = F.get("b", at - 1), F.get("b", at - 2)
    start = F.when(at > 1, below["le"]).otherwise(0.0)
    under = F.when(at > 1, below["n"]).otherwise(0.0)
    inside = F.when((at == 1) & (hit["le"] <= 0), hit["le"]).otherwise(start + (hit["le"] - start) * F.try_divide(rank - under, hit["n"] - under))
    nan = F.lit(float("nan"))
    if quantile < 0 or quantile > 1:
        inside = F.lit(float("inf") if quantile > 1 else float("-inf"))
    else:
        inside = F.when(at == 0, F.get("b", size - 2)["le"]).otherwise(F.coalesce(inside, nan))
    value = F.when((size < 2) | (F.element_at("b", -1)["le"] != float("inf")) | F.coalesce(total == 0, F.lit(True)), nan).otherwise(inside)
    return held.select(*by, value.alias("value"))


def latest(gauges: DataFrame, labels: Sequence[str], columns: Sequence[str], step: int, lookback: int = LOOKBACK) -> DataFrame:
    """(at, columns…): at each multiple of the step the largest of all series' last values, not older than `lookback`."""
    rows = gauges.where("at is not null").withColumn("end", F.explode(ends_of_windows(F.col("at").cast("double"), lookback, step)))
    last = rows.groupBy(*labels, "end").agg(F.max_by(F.struct(*columns), "at").alias("v"))
    return last.groupBy(F.col("end").alias("at")).agg(*[F.max(F.col(f"v.{c}")).alias(c) for c in columns])


def rule_samples(gauges: DataFrame, gauge_labels: Sequence[str], answers: DataFrame, drops: DataFrame, step: int = 60, window: int = 600) -> DataFrame:
    """What the alert rules read, at each multiple of the step from the first sample to the last: gauges(labels…, at, up, …),
    and from the counters answers(confidence, grounded, at, value) and drops(outcome, at, value) calls_10m, bad_10m (errors,
    and answers that are not grounded) and drop_failures_10m. Without samples a gauge is null and an increase absent."""
    columns = [c for c in gauges.columns if c not in (*gauge_labels, "at")]
    wrong = (F.col("confidence") == "error") | (F.col("grounded") == "false")
    called = increases(answers, ["confidence", "grounded"], window, step).groupBy("at").agg(F.sum("increase").alias("calls_10m"), F.sum(F.when(wrong, F.col("increase")).otherwise(0.0)).alias("bad_10m"))
    failed = increases(drops, ["outcome"], window, step).where(~F.col("outcome").isin("success", "ok", "already_exists")).groupBy("at").agg(F.sum("increase").alias("drop_failures_10m"))
    known = latest(gauges, gauge_labels, columns, step)
    each = [known, called, failed]
    span = each[0].select("at").unionByName(each[1].select("at")).unionByName(each[2].select("at")).agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    grid = span.where("lo is not null").select(F.explode(F.sequence("lo", "hi", F.lit(step).cast("long"))).alias("at"))
    for part in each:
        grid = grid.join(part, "at", "left")
    return grid


def counter_alerts(gauges: DataFrame, gauge_labels: Sequence[str], answers: DataFrame, drops: DataFrame, step: int = 60) -> DataFrame:
    """(at, rule, severity): the alert rules over gauges and counters, each held for as long as it asks."""
    return status.series_alerts(rule_samples(gauges, gauge_labels, answers, drops, step))
