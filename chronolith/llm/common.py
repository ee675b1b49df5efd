"""What the operators of this subpackage share: shared scratch tables, blobs, crc splits, connected components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable
from functools import reduce
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


ARROW_ROWS = 2_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir or the context's checkpoint folder. Only a local
    master, whose executors are this process, may do without: it gets a folder of its own."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not set_dir:
        sc = spark.sparkContext
        if sc.getCheckpointDir() is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        set_dir = sc.getCheckpointDir()
    return set_dir


def bound_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Lets Arrow batches hold `rows` rows at most: texts are long, and the default of 10,000 of them takes hundreds of MB
    in a task and in its Python worker. A session that asks for fewer keeps its setting."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


class Scratch:
    """Tables written below the shared folder. A written table cuts lineage and outlives lost executors. What a returned
    DataFrame still reads stays; everything else is dropped as soon as no later step reads it."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
        self.paths: dict[str, str] = {}
        bound_batches(spark)

    def table(self, df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
        path = f"{self.base}/{name}-{uuid.uuid4().hex[:6]}"
        df.write.parquet(path, partitionBy=partition_by)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def delete(self, path: str) -> None:
        jpath = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(jpath, True)

    def drop(self, *names: str) -> None:
        """Deletes tables that no later plan reads."""
        for name in names:
            if path := self.paths.pop(name, None):
                self.delete(path)

    def clear(self) -> None:
        """Deletes all of it, once results are on the driver or written elsewhere."""
        self.delete(self.base)
        self.paths.clear()

    def release(self) -> None:
        """Shuffle files of plans that nobody holds any more are deleted by Spark's cleaner, which the JVM's collector
        wakes up."""
        self.spark._jvm.System.gc()


class Shared:
    """A broadcast object of any class. It travels with its class by value, so that workers need no copy of this
    package on their path. Callers bound its size."""

    def __init__(self, spark: SparkSession, value):
        bound_batches(spark)
        self.blob = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    @property
    def value(self):
        return cloudpickle.loads(self.blob.value)

    def destroy(self) -> None:
        """Frees all copies; no later plan may read it."""
        self.blob.destroy()


def default_parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def buckets_for(rows: DataFrame, text_col: str, most: int) -> int:
    """How many hash buckets the texts take if none is to gather more than about `most` bytes; at least one for each
    shuffle partition."""
    size = rows.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(default_parallelism(rows.sparkSession), -(-size // most))


def byte_column(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A string or binary column as bytes, null as empty."""
    col = batch.column(name)
    if not pa.types.is_binary(col.type):
        col = col.cast(pa.binary())
    return [x if x is not None else b"" for x in col.to_pylist()]


def text_column(batch: pa.RecordBatch, name: str) -> list[str]:
    return [x if x is not None else "" for x in batch.column(name).to_pylist()]


def expand(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers start[0], ..., start[0] + size[0] - 1, start[1], ..."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + size, size)


def having(rows: DataFrame, ids: DataFrame, keys: dict[str, Column], how: str = "left_semi", most: int = 500_000) -> DataFrame:
    """The rows for which `keys` (a column of ids: its value in rows; null is a value like others) stand among ids, or with
    left_anti those for which they don't. Few ids, as counted in their written table, are broadcast, and the rows' texts stay
    where they are. Rows may have columns of any names."""
    taken = {c.lower() for c in rows.columns}
    names = {k: next(n for i in count() if (n := f"had_{k}_{i}") not in taken) for k in keys}
    own = ids.select(*[F.col(k).alias(n) for k, n in names.items()])
    if own.count() <= most:
        own = F.broadcast(own)
    return rows.join(own, reduce(lambda a, b: a & b, [value.eqNullSafe(F.col(names[k])) for k, value in keys.items()]), how)


def give_back() -> None:
    """Returns freed memory to the system. Python workers are used again and again, and what the largest group of one stage
    took would otherwise count in all later ones."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        return


def tidy(f: Callable[[pd.DataFrame], pd.DataFrame]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """A function of one group that gives memory back behind it."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        try:
            return f(pdf)
        finally:
            give_back()

    return run


def tidy_pair(f: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """A function of two cogrouped groups that gives memory back behind it."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        try:
            return f(left, right)
        finally:
            give_back()

    return run


def pack(values: np.ndarray) -> bytes:
    """An array as a compressed blob; the reader states the type."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).tobytes())


def unpack(blob: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=dtype)


def crc_of_id(column="doc_id"):
    """crc32 of the id as text, unsigned."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """Connected components of edges(a long, b long): one row (id, component) for each id in an edge,
    component being the smallest id reachable. Alternates large-star and small-star steps (Kiveris et al. 2014):
    only minima are gathered by key, never neighbour lists, and each round is a written table. What a hub, which has a
    share of all edges, tells its neighbours is broadcast: there are few hubs, by the number of edges.
    Loops and repeated edges are harmless; an empty input gives no row; rows with a null end are ignored."""
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    cur, state = scratch.table(e, "cc"), None
    parts = default_parallelism(scratch.spark)
    for _ in range(max_rounds):
        degrees = cur.groupBy("v").agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"))
        total, most, check = degrees.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.sum("h"), F.lit(0))).first()
        if not total or (total, check) == state:
            break
        state, last = (total, check), scratch.paths["cc"]
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        limit = max(1000, total // (2 * parts))
        tell = lambda r, how: r.join(low if how is None else how, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        up = both.where("v > u")
        if most > limit:  # at most 2 * parts hubs
            hubs = F.broadcast(degrees.where(F.col("n") > limit).select(F.col("v").alias("u")))
            large = tell(up.join(hubs, "u", "left_anti"), None).unionByName(tell(up, F.broadcast(low.join(hubs, "u"))))
        else:
            large = tell(up, None)
        large = large.where("u <> v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        cur = scratch.table(small.unionByName(low2.select("u", F.col("m").alias("v"))).distinct(), "cc")
        scratch.delete(last)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return cur.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        cur.select(F.col("v").alias("id"), F.col("v").alias("component"))
    ).distinct()
