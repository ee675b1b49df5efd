"""Structured Streaming forms: bounded resumable ingestion, late facts, windowed counts, idempotent drops, pairing."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from chronolith.functions import text as T
from chronolith.operators import facts as facts_ops
from chronolith.operators import ingest as ingest_ops
from chronolith.operators import usage

BATCH_FILES = 15


def note_stream(spark: SparkSession, path: str, schema: str, files: int = BATCH_FILES) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


class Folders:
    """Folders below a path of the shared store."""

    def __init__(self, spark: SparkSession, root: str):
        self.root, self.jvm = root.rstrip("/"), spark._jvm
        self.fs = self.path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def there(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def names(self, name: str = "") -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(name))) if self.there(name) else []


def day_of(slug: Column) -> Column:
    """The folder of a note: the day that its slug begins with, which it keeps for good."""
    return F.coalesce(F.date_format(T.slug_timestamp(slug), "yyyy-MM-dd"), F.lit("none"))


def written_before(spark: SparkSession, target: str, number: int, days: list[str], schema: str) -> DataFrame:
    """What other batches than this one wrote below target for these days; other days' folders are not even listed."""
    folders = Folders(spark, target)
    found = [f"{folders.root}/day={d}" for d in days if folders.there(f"day={d}")]
    if not found:
        return spark.createDataFrame([], schema)
    return spark.read.schema(f"{schema}, day string, batch long").option("basePath", folders.root).parquet(*found).where(F.col("batch") != number).drop("batch", "day")


def ingest(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Takes all notes that are there in batches, each note and content once. The target is keyed by the slugs' days: a note
    that comes again has its old slug, so a batch looks for what was written before in its own notes' days only, however
    long the history is. A batch's folders bear its number, so that one run again after a crash overwrites its own output."""

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        keyed = batch.withColumn("day", day_of(F.col("slug")))
        days = [r.day for r in keyed.select("day").distinct().collect()]  # at most as many as a batch has notes
        before = written_before(spark, target, number, days, "slug string, content_hash string")
        rows = ingest_ops.unseen(keyed, before).withColumn("batch", F.lit(number).cast("long"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(target)

    return stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(one).start()


def version(spark: SparkSession, checkpoint: str) -> str:
    """The version of what a stream has written, for caches: the last batch that it committed, 'none' before the first. An
    answer made while a batch is being written is kept under the version before, and goes when the batch is committed."""
    numbers = [int(n) for n in Folders(spark, f"{checkpoint.rstrip('/')}/commits").names() if n.isdigit()]
    return str(max(numbers)) if numbers else "none"


def compact(spark: SparkSession, target: str, before: str) -> int:
    """Puts the batches of each day before the one given into one folder, batch=-1; returns how many days were put together.
    The new folder stands aside until it is whole; a run that broke off between taking the old ones away and moving it in
    is ended by the next. Not to be run beside an ingestion that still writes to these days."""
    folders, aside, done = Folders(spark, target), Folders(spark, f"{target.rstrip('/')}_aside"), 0
    for name in sorted({*folders.names(), *(n for n in aside.names() if aside.there(f"{n}/_SUCCESS"))}):
        day, whole = name.removeprefix("day="), aside.there(f"{name}/_SUCCESS")
        if not name.startswith("day=") or day == "none" or day >= before:
            continue
        batches = folders.names(name)
        if batches == ["batch=-1"] and not whole:
            continue
        if not whole:
            spark.read.parquet(f"{folders.root}/{name}").drop("batch").coalesce(1).write.mode("overwrite").parquet(f"{aside.root}/{name}")
        folders.fs.delete(folders.path(name), True)
        folders.fs.mkdirs(folders.path(name))
        folders.fs.rename(aside.path(name), folders.path(f"{name}/batch=-1"))
        done += 1
    return done


def late_facts(stream: DataFrame, events: str, facts: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Facts that arrive late change their neighbours' intervals: the one before a new event closes when it begins, and it
    closes when the one behind begins. Events lie in buckets by a hash of the subject, ordered by it; a batch reads the
    times of its own subjects there, and adds to facts the new rows and those right before them, at most two for each event,
    under its number. `current_facts` reads the newest row of each. A fact that comes again replaces its older self, of the same
    subject. `buckets` must not change."""

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64("subject"), F.lit(buckets)).cast("int")
        new = batch.dropDuplicates(["uuid"]).withColumn("bucket", bucket).withColumn("batch", F.lit(number).cast("long"))
        new.sortWithinPartitions("subject").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(events)
        subjects = new.select("subject", "bucket").distinct().collect()  # a batch's
        history = spark.read.schema(new.schema).option("basePath", events).parquet(*[f"{events}/bucket={b}" for b in {r.bucket for r in subjects}])
        mine = history.where(F.col("subject").isin([r.subject for r in subjects]) & (F.col("batch") <= number))
        newest = mine.withColumn("n", F.row_number().over(Window.partitionBy("subject", "uuid").orderBy(F.desc("batch")))).where("n = 1").drop("n")
        line = Window.partitionBy("subject").orderBy("valid_at", "uuid")
        closed = facts_ops.close_intervals(newest, "subject").withColumn("next", F.lead("batch").over(line))
        moved = mine.where(F.col("batch") < number).join(new.select("uuid"), "uuid", "left_semi").select("subject", F.col("valid_at").alias("was"))
        # where an event moved, the one before its old place changes as well
        left = newest.join(moved, "subject").where(F.col("valid_at") <= F.col("was")).groupBy("subject", "was").agg(F.max_by("uuid", F.struct("valid_at", "uuid")).alias("uuid")).select("uuid").distinct()
        touched = closed.join(left.withColumn("beside", F.lit(True)), "uuid", "left").where((F.col("batch") == number) | (F.col("next") == number) | F.col("beside"))
        touched.drop("next", "beside").withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(facts)

    return stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(one).start()


def current_facts(rows: DataFrame) -> DataFrame:
    """Of rows(uuid, batch, …) that `late_facts` wrote the newest of each fact."""
    newest = rows.groupBy("uuid").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "uuid"]), "batch").alias("r"))
    return newest.select("uuid", "r.*").drop("batch", "bucket")


def windowed_counts(stream: DataFrame, late: str, width: str, slide: str | None = None) -> DataFrame:
    """Counts by window, tool and outcome, final once the watermark has passed; ts must be TIMESTAMP."""
    return usage.windowed(stream.withWatermark("ts", late), width, slide)


def once(stream: DataFrame, late: str) -> DataFrame:
    """Drops repeats of (capture_hash, slug) that come within `late` of each other: bounded state."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["capture_hash", "slug"])


def pair_runs(stream: DataFrame, timeout_seconds: int = 3600, late_seconds: int = 600) -> DataFrame:
    """events(session, call_id, ts double, kind) -> (session, call_id, started, ended): starts wait in state for their
    end. One is given up (ended null) once events are timeout_seconds and late_seconds further by their own time; events
    more than late_seconds behind the newest of earlier batches are dropped. As nothing waits for the clock, a run over
    what is available ends."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        started, out = (state.get[0] if state.exists else None), []
        if state.hasTimedOut:
            out, started = [(*key, started, None)], None
        else:
            events = pd.concat(list(frames)).sort_values(["ts", "kind"], ascending=[True, False])  # a start before an end
            for kind, ts in events[["kind", "ts"]].itertuples(index=False):
                if kind == "tool_start":
                    started = ts
                elif started is not None:
                    out.append((*key, started, ts))
                    started = None
        if started is None:
            if state.exists:
                state.remove()
        else:
            state.update((started,))
            state.setTimeoutTimestamp(max(int((started + timeout_seconds) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["session", "call_id", "started", "ended"]).astype({"started": "float64", "ended": "float64"})

    timed = stream.where(F.col("kind").isin("tool_start", "tool_end")).withColumn("at", F.timestamp_seconds("ts")).withWatermark("at", f"{late_seconds} seconds")
    keyed = timed.groupBy("session", "call_id")
    return keyed.applyInPandasWithState(step, "session string, call_id string, started double, ended double", "started double", "append", GroupStateTimeout.EventTimeTimeout)


def pair_calls(stream: DataFrame, timeout_seconds: int = 3600, late_seconds: int = 600) -> DataFrame:
    """events(session, call_id, ts double, kind) -> (session, call_id, started, ended), for call ids that a session uses once:
    a stream-stream join in the JVM. An end belongs to the start at most timeout_seconds before it; a start without one comes
    out, ended null, once both sides' events are past that and late_seconds. An end without a start gives no row."""
    timed = stream.withColumn("at", F.timestamp_seconds("ts")).withWatermark("at", f"{late_seconds} seconds")
    side = lambda kind, name: timed.where(F.col("kind") == kind).select(F.col("session").alias(f"{name}_session"), F.col("call_id").alias(f"{name}_call"), F.col("ts").alias(name), F.col("at").alias(f"{name}_at"))
    near = f"end_session = start_session and end_call = start_call and end_at >= start_at and end_at <= start_at + interval {timeout_seconds} seconds"
    joined = side("tool_start", "start").join(side("tool_end", "end"), F.expr(near), "left_outer")
    return joined.select(F.col("start_session").alias("session"), F.col("start_call").alias("call_id"), F.col("start").alias("started"), F.col("end").alias("ended"))


def backoff_seconds(failures: int, cap: int = 20) -> int:
    """Wait before the next try: powers of two up to the cap."""
    return min(2**failures, cap)
