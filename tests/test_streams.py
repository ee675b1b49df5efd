"""Streams whose batches touch only what they change, and the as-of merge."""

import glob
import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from chronolith.operators import facts, order
from chronolith.streaming import notes

DAY = datetime(2024, 1, 1)
FACT = "uuid long, subject long, object string, valid_at timestamp"


def run(query):
    try:
        assert query.awaitTermination(180)
    finally:
        query.stop()


def rows_of(df, *names):
    return sorted(map(tuple, df.select(*names).collect()), key=repr)


@pytest.mark.parametrize("days", [1, 30, 10_000])
def test_merge_equals_the_join_with_a_hot_key(spark, days):
    rng = random.Random(days)
    pick = lambda: 0 if rng.random() < 0.5 else rng.choice([1, 2, 3, 4, None])
    when = lambda: DAY + timedelta(hours=rng.randrange(24 * 200)) if rng.random() < 0.97 else None
    events = spark.createDataFrame([(n, pick(), f"o{n % 5}", when()) for n in range(200)], FACT)
    closed = facts.close_intervals(events, "subject")
    gaps = closed.withColumn("invalid_at", F.when(F.col("uuid") % 9 == 0, F.least("invalid_at", F.col("valid_at") + F.expr("interval 2 hours"))).otherwise(F.col("invalid_at")))
    points = spark.createDataFrame([(pick(), n, when(), n % 3) for n in range(400)] + [(0, 900 + k, DAY + timedelta(hours=12 * k), 0) for k in range(60)], "subject long, point long, at timestamp, piece long")
    for f in (closed, gaps):
        f = f.where("valid_at is not null").repartition(4)
        want = facts.as_of_join(points, f, "subject", "at")
        names = ["subject", "point", "at", "piece", "uuid", "object", "valid_at", "invalid_at"]
        got = facts.as_of_merge(points.repartition(3), f, "subject", "at", days)
        assert rows_of(got, *names) == rows_of(want, *names) and want.count() > 150
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1  # with one row for each key and piece
    with pytest.raises(ValueError):
        facts.as_of_merge(points.withColumn("uuid", F.lit(1)), closed, "subject", "at")
    assert facts.as_of_merge(points.limit(0), closed, "subject", "at").count() == facts.as_of_merge(points, closed.limit(0), "subject", "at").count() == 0


def test_a_batch_reads_its_own_days_only_and_days_can_be_put_together(spark, tmp_path):
    source, target, schema = str(tmp_path / "in"), str(tmp_path / "out"), "slug string, body string"

    def take(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        run(notes.ingest(notes.note_stream(spark, source, schema), target, str(tmp_path / "cp")))

    slug = lambda day, n: f"2024-01-{day:02}-100000-n{n}"
    assert notes.version(spark, str(tmp_path / "cp")) == "none"
    for day in range(1, 6):
        take([(slug(day, n), f"body {n}") for n in range(4)] + [("no-time", "x")])
    assert notes.version(spark, str(tmp_path / "cp")) == "4"  # five batches
    read = {f: os.path.getsize(f) for f in glob.glob(f"{target}/day=2024-01-0[1-4]/*/*.parquet")}
    for f in read:
        os.rename(f, f"{f}.away")
        open(f, "wb").close()  # whoever opens it fails
    take([(slug(5, 1), "body 1"), (slug(5, 1), "new"), ("no-time", "x"), ("no-time", "y")])
    for f in read:
        os.rename(f"{f}.away", f)
    want = sorted([(slug(d, n), f"body {n}") for d in range(1, 6) for n in range(4)] + [(slug(5, 1), "new"), ("no-time", "x"), ("no-time", "y")])
    assert rows_of(spark.read.parquet(target), "slug", "body") == want
    for d in range(5, 1, -1):
        take([(slug(d, 9), f"late {d}")])
    want = sorted([*want, *((slug(d, 9), f"late {d}") for d in range(2, 6))])
    assert notes.compact(spark, target, "2024-01-05") == 4 and rows_of(spark.read.parquet(target), "slug", "body") == want
    assert all(os.listdir(f"{target}/day=2024-01-0{d}") == ["batch=-1"] for d in range(1, 5)) and notes.compact(spark, target, "2024-01-05") == 0
    take([(slug(2, 9), "late 2"), (slug(2, 8), "later")])  # put together, and still known
    want = sorted([*want, (slug(2, 8), "later")])
    assert rows_of(spark.read.parquet(target), "slug", "body") == want
    # a run that broke off when the old folders were gone and the new one not moved in
    spark.read.parquet(f"{target}/day=2024-01-02").drop("batch").coalesce(1).write.parquet(f"{target}_aside/day=2024-01-02")
    spark._jvm.org.apache.hadoop.fs.FileSystem.get(spark._jsc.hadoopConfiguration()).delete(spark._jvm.org.apache.hadoop.fs.Path(f"{target}/day=2024-01-02"), True)
    assert notes.compact(spark, target, "2024-01-05") == 1 and rows_of(spark.read.parquet(target), "slug", "body") == want


def test_late_facts_in_any_order_with_few_rows_written(spark, tmp_path):
    rng, schema, at = random.Random(6), FACT, str(tmp_path)
    rows = [(n, n % 3, f"o{n}", DAY + timedelta(hours=rng.randrange(60))) for n in range(36)]
    rng.shuffle(rows)
    rows += [(5, 2, "moved", DAY + timedelta(hours=70)), (6, 0, "moved back", DAY), (rows[0][0], *rows[0][1:])]
    for k in range(0, len(rows), 7):
        spark.createDataFrame(rows[k : k + 7], schema).coalesce(1).write.mode("append").parquet(f"{at}/in")
        run(notes.late_facts(notes.note_stream(spark, f"{at}/in", schema), f"{at}/events", f"{at}/facts", f"{at}/cp", buckets=4))
    written = spark.read.parquet(f"{at}/facts")
    newest = spark.createDataFrame(list({r[0]: r for r in rows}.values()), schema)
    names = ["uuid", "subject", "object", "valid_at", "invalid_at"]
    assert rows_of(notes.current_facts(written), *names) == rows_of(facts.close_intervals(newest, "subject"), *names)
    assert written.count() <= 3 * len(rows) and max(r["count"] for r in written.groupBy("batch").count().collect()) <= 3 * 7


def test_calls_are_paired_in_the_jvm_and_a_lost_start_comes_out(spark, tmp_path):
    source, out, schema = str(tmp_path / "in"), str(tmp_path / "pairs"), "session string, call_id string, ts double, kind string"

    def take(*rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        pairs = notes.pair_calls(notes.note_stream(spark, source, schema), timeout_seconds=3600)
        run(pairs.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).option("path", out).trigger(availableNow=True).start())
        return pairs

    take(("s", "c", 1.0, "tool_start"), ("s", "d", 2.0, "tool_start"), ("s", "e", 9.0, "tool_end"))
    take(("s", "c", 3.0, "tool_end"), ("t", "c", 4.0, "tool_start"))
    take(("t", "c", 4000.0, "tool_end"), ("u", "x", 9000.0, "tool_start"), ("u", "x", 9001.0, "tool_end"))
    pairs = take(("u", "y", 9002.0, "tool_start"), ("u", "z", 9003.0, "tool_end"))
    assert rows_of(spark.read.parquet(out), "session", "call_id", "started", "ended") == [("s", "c", 1.0, 3.0), ("s", "d", 2.0, None), ("t", "c", 4.0, None), ("u", "x", 9000.0, 9001.0)]
    assert "Python" not in pairs._jdf.queryExecution().analyzed().toString()


def test_a_merge_deals_many_rows_to_more_tasks(spark, monkeypatch):
    monkeypatch.setattr(facts, "dealt", lambda rows, *keys, count: order.dealt(rows, *keys, count=count, most=50))
    f = facts.close_intervals(spark.createDataFrame([(n, n % 9, f"o{n}", DAY + timedelta(days=n)) for n in range(300)], FACT), "subject")
    points = spark.createDataFrame([(n % 9, n, DAY + timedelta(hours=7 * n)) for n in range(900)], "subject long, point long, at timestamp")
    got = facts.as_of_merge(points, f, "subject", "at", rows=1200)
    assert got.rdd.getNumPartitions() == 24
    assert rows_of(got, "point", "uuid") == rows_of(facts.as_of_join(points, f, "subject", "at"), "point", "uuid")
