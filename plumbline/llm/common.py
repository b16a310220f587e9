"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the session's ``spark.checkpoint.dir``; only where that is unset and the session runs
    on one machine (``local``) a temporary folder is made. On a cluster an unset folder is an error.
    """
    sc = spark.sparkContext
    found = sc.getCheckpointDir()
    if found is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="plumbline-"))
        found = sc.getCheckpointDir()
    return found


#: Folders that ``materialise`` wrote and nothing has released yet.
_written: list[str] = []


def written() -> int:
    """How many tables wait to be released: a mark for ``release``."""
    return len(_written)


def release(spark: SparkSession, start: int = 0, end: int | None = None) -> None:
    """Delete the written tables from mark ``start`` to ``end``; nothing may read them any more."""
    sc = spark.sparkContext
    for name in _written[start:end]:
        path = sc._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
    del _written[start:end]


def materialise(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage in a way that outlives any executor.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/plumbline-{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    _written.append(path)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def held_out(doc_id: str | Column, modulus: int, remainder: int) -> Column:
    """True where crc32(doc_id as text) mod ``modulus`` is ``remainder``."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string")) % modulus == remainder, F.lit(False))


def trim() -> None:
    """Give memory that is free back to the system: workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give_back:
        give_back(0)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, rows: int | None = None) -> DataFrame:
    """``mapInArrow`` for a function from one batch to one batch; with ``rows``, a batch of more is taken in parts of so many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows or batch.num_rows or 1):
                if (out := fn(batch.slice(at, rows) if rows else batch)) is not None:
                    yield out
        trim()

    return df.mapInArrow(run, schema)


#: A key that holds at least this share of the rows counts as hot.
HOT_SHARE = 1 / 1024


def hot_keys(counts: DataFrame, keys: str | list[str], n: str, total: int) -> DataFrame:
    """The keys of a counted table that hold ``HOT_SHARE`` of ``total`` rows.

    There are at most 1 / HOT_SHARE of them, so the result may be broadcast.
    """
    return counts.where(F.col(n) >= max(2, int(total * HOT_SHARE))).select(keys)


def join_on_skewed_key(rows: DataFrame, dim: DataFrame, hot: DataFrame, keys: str | list[str], how: str = "inner") -> DataFrame:
    """Join ``rows`` to ``dim`` (unique on ``keys``) where few keys hold most rows.

    Rows with a hot key meet a broadcast part of ``dim``, which holds at most
    1 / HOT_SHARE rows; all other rows go through an ordinary shuffled join.
    """
    mark = F.broadcast(hot.select(keys).withColumn("__hot", F.lit(True)))
    marked = rows.join(mark, keys, "left")
    warm = marked.where(F.col("__hot").isNull()).drop("__hot").join(dim, keys, how)
    few = dim.join(F.broadcast(hot.select(keys)), keys, "left_semi")
    return warm.unionByName(marked.where("__hot").drop("__hot").join(F.broadcast(few), keys, how))
