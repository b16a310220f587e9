"""Connected components by min-label stars, each round written to the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _shared(df: DataFrame) -> str:
    """The folder that all executors share."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp())
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df``, written to the shared folder."""
    _shared(df)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``df``, written to the shared folder by columns: for wide rows of which each reader wants a few columns or rows."""
    path = f"{_shared(df)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clusters(pairs: DataFrame, rounds: int = 50) -> DataFrame:
    """(id, cluster) of every id in ``pairs`` (a, b): the smallest id that can be reached."""
    both = cut(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("c")))
    for _ in range(rounds):
        near = both.join(labels.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.min("c").alias("n"))
        step = labels.join(near, "a").select("a", F.least("c", "n").alias("c"))
        # pointer jumping: take the label of the label
        jump = step.alias("s").join(step.select(F.col("a").alias("c"), F.col("c").alias("up")), "c").select("a", F.least("c", "up").alias("c"))
        new = cut(jump)
        done = new.join(labels.withColumnRenamed("c", "old"), "a").where("c <> old").limit(1).count() == 0
        labels = new
        if done:
            return labels.select(F.col("a").alias("id"), F.col("c").alias("cluster"))
    raise RuntimeError("labels did not settle")
