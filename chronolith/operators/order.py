"""Order numbers without gathering rows in one task, and checkpoints."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder, which driver and executors share: the one that spark.checkpoint.dir names. Where it is unset, a
    local session, whose executors are its own process, gets a folder of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def saved(df: DataFrame) -> DataFrame:
    """Checkpointed in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def dealt(rows: DataFrame, *keys: str, count: int | None = None, most: int = 1_000_000) -> DataFrame:
    """The rows shuffled by the keys' values, in so many partitions that one takes about `most` of them, so that what a task
    sorts does not grow with the table. count: how many there are, if that is known; else they are counted. Few rows are
    left to the plan's own shuffles."""
    parts = -(-(rows.count() if count is None else count) // most)
    return rows.repartition(parts, *keys) if parts > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """Adds number, from 0 in the given order, without gathering the rows in one task: each range partition numbers its
    own and adds how many rows stand before it."""
    dealt = saved(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    sizes = dealt.groupBy("part").count()
    before = sizes.withColumn("before", F.sum("count").over(Window.orderBy("part")) - F.col("count")).select("part", "before")  # a row a partition
    own = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    return dealt.withColumn("own", own).join(F.broadcast(before), "part").withColumn("number", F.col("own") + F.col("before")).drop("part", "own", "before")
