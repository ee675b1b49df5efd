"""Readers and writers: note trees, page trees, queues, the query log, the embedding cache, change and agent logs."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from chronolith.functions import text as T
from chronolith.operators import pages as P
from chronolith.operators.order import saved

QUERY_EVENT = S.StructType([
    S.StructField("ts", S.DoubleType()), S.StructField("source", S.StringType()), S.StructField("tool", S.StringType()), S.StructField("metric_tool", S.StringType()),
    S.StructField("query", S.StringType()), S.StructField("question", S.StringType()), S.StructField("subject", S.StringType()), S.StructField("name", S.StringType()), S.StructField("slug", S.StringType()),
    S.StructField("k", S.IntegerType()), S.StructField("n", S.IntegerType()), S.StructField("n_facts", S.IntegerType()), S.StructField("n_entities", S.IntegerType()),
    S.StructField("top", S.ArrayType(S.StructType([S.StructField("name", S.StringType()), S.StructField("score", S.DoubleType())]))),
    S.StructField("confidence", S.StringType()), S.StructField("cached", S.BooleanType()), S.StructField("grounded", S.BooleanType()), S.StructField("grounding_action", S.StringType()),
    S.StructField("answer_tokens_est", S.LongType()), S.StructField("packet_tokens_est", S.LongType()), S.StructField("duration_ms", S.DoubleType()),
    S.StructField("outcome", S.StringType()), S.StructField("error", S.StringType()), S.StructField("hit", S.BooleanType()), S.StructField("test", S.BooleanType()), S.StructField("broken", S.StringType()),
])
AGENT_EVENT = "session string, seq long, ts double, kind string, call_id string, tokens long, cost double, error string"
HASH_FORMATS = ("legacy-body-v0", "embedding-input-v1")
MAX_DAYS, MAX_EVENTS = 365, 5000


def markdown(spark: SparkSession, root: str, priority: int = 0) -> DataFrame:
    """(path, content, modified, root_priority) of all *.md files below a root in any store that Spark reads."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(root)
    return files.select("path", F.col("content").cast("string").alias("content"), F.col("modificationTime").alias("modified"), F.lit(priority).alias("root_priority"))


def discover_notes(*roots: DataFrame) -> DataFrame:
    """(slug, ts, path, body) of notes <slug>/<slug>.md with a timestamp slug, none below .blocked; of equal slugs the
    first root's, then the lowest path. A slug with an impossible date is dropped."""
    rows = roots[0]
    for r in roots[1:]:
        rows = rows.unionByName(r)
    rows = rows.withColumn("slug", P.stem(F.col("path"))).withColumn("ts", T.slug_timestamp(F.col("slug")))
    rows = rows.where(F.col("ts").isNotNull() & (F.col("slug") == P.parent(F.col("path"))) & ~F.array_contains(P.parts(F.col("path")), ".blocked"))
    first = F.row_number().over(Window.partitionBy("slug").orderBy("root_priority", "path"))
    return rows.withColumn("rn", first).where("rn = 1").select("slug", "ts", "path", F.col("content").alias("body"))


def queue_entries(files: DataFrame, queue: str) -> DataFrame:
    """(queue, slug, ts): entries of a queue folder, the slug's time or else the file's."""
    name = F.when(P.stem(F.col("path")).isin("NOTE", "BLOCKED"), P.parent(F.col("path"))).otherwise(P.stem(F.col("path")))
    rows = files.select(name.alias("slug"), "modified").where("slug not like '.%' and slug <> 'README'")
    return rows.groupBy("slug").agg(F.max("modified").alias("modified")).select(F.lit(queue).alias("queue"), "slug", F.coalesce(T.slug_timestamp(F.col("slug")), "modified").alias("ts"))


def log_paths(spark: SparkSession, path: str, since: float) -> list[str]:
    """What of a log may hold events from `since` on: its day folders from the day before on, as sessions may differ in their
    time zones, and whatever else lies there, as rotated files do. Other days' folders are not opened or even listed."""
    day = spark.range(1).select(F.date_format(F.timestamp_seconds(F.lit(since)), "yyyy-MM-dd")).first()[0]
    first = str(date.fromisoformat(day) - timedelta(days=1)) if day > "0001-01-01" else day
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root) or not fs.getFileStatus(root).isDirectory():
        return [path]
    names = [f.getPath().getName() for f in fs.listStatus(root)]
    return [f"{path.rstrip('/')}/{n}" for n in names if not n.startswith(("_", ".")) and (not n.startswith("day=") or n[4:] >= first)]


def read_query_log(spark: SparkSession, path: str, now: float, days: int, most: int = MAX_EVENTS) -> DataFrame:
    """The last `most` events of the window, oldest first; malformed lines are skipped, a missing ts counts as 0, days
    are clamped. Only the window's day folders are read. The most recent are a top-k, so nothing is sorted whole."""
    since = now - T.clamp(days, 0, MAX_DAYS) * 86400
    if not (found := log_paths(spark, path, since)):
        return spark.createDataFrame([], S.StructType([f for f in QUERY_EVENT if f.name != "broken"]))
    rows = spark.read.schema(QUERY_EVENT).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "broken").option("recursiveFileLookup", True).json(found)
    rows = rows.where("broken is null").drop("broken").withColumn("ts", F.coalesce("ts", F.lit(0.0)))
    return rows.where(F.col("ts") >= since).orderBy(F.desc("ts")).limit(most).orderBy("ts")


def append_query_log(events: DataFrame, path: str, keep_days: int | None = None) -> None:
    """Appends events below path, in a folder for each day of their ts. With keep_days the log is bounded: days that lie
    so far behind its newest are dropped, as a rotation drops its oldest files."""
    day = F.date_format(F.timestamp_seconds(F.coalesce("ts", F.lit(0.0))), "yyyy-MM-dd")
    events.withColumn("day", day).write.mode("append").partitionBy("day").json(path)
    if keep_days is None:
        return
    jvm, conf = events.sparkSession._jvm, events.sparkSession._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(conf)
    days = sorted(name[4:] for name in (f.getPath().getName() for f in fs.listStatus(root)) if name.startswith("day="))
    oldest = date.fromisoformat(days[-1]) - timedelta(days=keep_days - 1)
    for name in days:
        if date.fromisoformat(name) < oldest:
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{path}/day={name}"), True)


def read_group(spark: SparkSession, path: str, group_id: str) -> DataFrame:
    """Rows of one group of a node or edge table; where the table is partitioned by group, only its folder is read."""
    return spark.read.parquet(path).where(F.col("group_id") == group_id)


def read_embeddings(spark: SparkSession, path: str, model: str, dim: int) -> DataFrame:
    """Cache rows of this model, a known hash format and the right length; others count as not cached."""
    rows = spark.read.parquet(path)
    return rows.where((F.col("model") == model) & F.col("hash_format").isin(*HASH_FORMATS) & (F.size("vector") == dim))


def write_embeddings(cache: DataFrame, base: str, version: str) -> str:
    """Writes a new version beside the old one; the caller switches to the returned path once it is whole."""
    path = f"{base}/{version}"
    cache.write.partitionBy("model").parquet(path)
    return path


def change_log(lines: DataFrame) -> DataFrame:
    """lines(seq, value) of `status<TAB>path[<TAB>new path]` -> (seq, status, path); a rename counts under its new path."""
    parts = F.split(F.trim("value"), "\t")
    status = F.substring(parts[0], 1, 1)
    path = F.when(status == "R", F.coalesce(F.try_element_at(parts, F.lit(3)), parts[1])).otherwise(F.try_element_at(parts, F.lit(2)))
    return lines.where(F.size(parts) >= 2).select("seq", status.alias("status"), path.alias("path"))


def log_entries(content: DataFrame) -> DataFrame:
    """content(text) -> (seq, date text, text) of `## [YYYY-MM-DD …] ` entries; what stands before the first is no entry."""
    pieces = F.split("text", r"(?m)(?=^## \[\d{4}-\d{2}-\d{2}[^\]]*\] )")
    rows = content.select(F.posexplode(pieces).alias("seq", "text"))
    return rows.select("seq", F.regexp_extract("text", r"\A## \[(\d{4}-\d{2}-\d{2})[^\]]*\] ", 1).alias("date"), "text").where("date <> ''")


def latest_entry(content: DataFrame) -> DataFrame:
    """The first entry without its zero-review line."""
    first = log_entries(content).orderBy("seq").limit(1)
    return first.withColumn("text", F.regexp_replace("text", r"(?m)^.*\b0 (?:items? )?(?:for|flagged for) review.*\n?", ""))


def agent_events(lines: DataFrame) -> DataFrame:
    """lines(value) of JSON events; malformed ones are skipped. Works on streams."""
    return lines.select(F.from_json("value", AGENT_EVENT).alias("e")).where("e.kind is not null").select("e.*")


def decide_drops(requests: DataFrame, seen: DataFrame) -> DataFrame:
    """requests(slug, note_md, texts, binaries, at) against seen(folder, capture_hash) -> one row for each request, with
    binaries decoded and capture_hash, folder, already_exists, error.

    A payload that an earlier folder, or an earlier request of the same slug, holds already exists there; under another
    slug it is a new note. A new note whose folder exists, with another payload, is an error."""
    decoded = F.transform_values("binaries", lambda k, v: F.try_to_binary(v, F.lit("base64")))
    rows = requests.withColumn("error", T.note_error(F.col("slug"), F.col("note_md"), F.col("texts"), F.col("binaries"))).withColumn("binaries", decoded)
    rows = rows.withColumn("capture_hash", F.when(F.col("error").isNull(), T.payload_hash(F.col("note_md"), F.col("texts"), F.col("binaries"))))
    known = seen.select("capture_hash", F.col("folder").alias("known"))
    match = rows.where("error is null").select("slug", "capture_hash").distinct().join(known, "capture_hash").where(F.col("known").endswith(F.concat(F.lit("-"), F.col("slug"))))
    rows = rows.join(match.groupBy("slug", "capture_hash").agg(F.min("known").alias("old")), ["slug", "capture_hash"], "left")
    same = Window.partitionBy("slug", "capture_hash").orderBy("at")
    new = F.concat(F.date_format(F.first("at").over(same), "yyyy-MM-dd-HHmmss"), F.lit("-"), F.col("slug"))
    valid = rows.where("error is null").withColumns({"folder": F.coalesce("old", new), "repeat": F.row_number().over(same) > 1})
    taken = seen.select(F.col("folder")).distinct().withColumn("taken", F.lit(True))
    valid = valid.join(taken, "folder", "left").withColumn("first_hash", F.min(F.when(F.col("old").isNull(), F.col("capture_hash"))).over(Window.partitionBy("folder")))
    clash = F.col("old").isNull() & (F.col("taken").isNotNull() | (F.col("first_hash") != F.col("capture_hash")))
    valid = valid.withColumn("error", F.when(clash, "folder exists"))
    columns = ["slug", "note_md", "texts", "binaries", "at", "capture_hash"]
    out = valid.select(*columns, "folder", ((F.col("old").isNotNull() | F.col("repeat")) & ~clash).alias("already_exists"), "error")
    refused = rows.where("error is not null").select(*columns, F.concat(F.date_format("at", "yyyy-MM-dd-HHmmss"), F.lit("-"), F.col("slug")).alias("folder"), F.lit(False).alias("already_exists"), "error")
    return out.unionByName(refused)


def drop_notes(requests: DataFrame, seen: DataFrame, notes: str) -> DataFrame:
    """Decides on requests as decide_drops does, appends the new notes with their text and binary attachments in one write
    job, partitioned by day, and returns (slug, folder, ok, already_exists, error) for each request. The decisions are
    checkpointed before the write, so that what is returned does not depend on what was written."""
    decided = saved(decide_drops(requests, seen))
    new = decided.where("error is null and not already_exists").withColumn("day", F.to_date("at"))
    new.select("folder", "slug", "note_md", "texts", "binaries", "capture_hash", "day").write.mode("append").partitionBy("day").parquet(notes)
    return decided.select("slug", "folder", F.col("error").isNull().alias("ok"), "already_exists", "error")
