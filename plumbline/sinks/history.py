"""Kept results: scans with retention, analyzer findings by content key, and baselines with a version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEPT_SCANS = 10


def _folders(spark: SparkSession, root: str, column: str) -> list[tuple[str, object]]:
    """(value, path) of the partition folders below ``root``; their number is bounded by what is kept."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(root)
    system = at.getFileSystem(conf)
    if not system.exists(at):
        return []
    return [(s.getPath().getName().split("=", 1)[1], s.getPath()) for s in system.listStatus(at) if s.getPath().getName().startswith(column + "=")]


def save_scan(rows: DataFrame, root: str, scan_id: str, keep: int = KEPT_SCANS) -> list[str]:
    """Write ``rows`` as one scan and drop all but the last ``keep`` by id; the ids that are left.

    A scan is written to its own folder as a whole, so a write that is tried again replaces itself.
    """
    spark = rows.sparkSession
    rows.write.mode("overwrite").parquet(f"{root.rstrip('/')}/scan_id={scan_id}")
    found = sorted(_folders(spark, root, "scan_id"), key=lambda x: x[0])
    for _, path in found[: max(0, len(found) - keep)]:
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return [name for name, _ in found[-keep:]]


def load_scan(spark: SparkSession, root: str, scan_id: str | None = None) -> DataFrame | None:
    """The rows of a scan, by default of the last; None where there is none."""
    ids = sorted(name for name, _ in _folders(spark, root, "scan_id"))
    chosen = scan_id if scan_id is not None else ids[-1] if ids else None
    return spark.read.parquet(f"{root.rstrip('/')}/scan_id={chosen}") if chosen in ids else None


def save_versioned(rows: DataFrame, path: str, version: int) -> None:
    """A baseline or an index: its version is a column, so a reader can refuse it."""
    rows.withColumn("__version", F.lit(version)).write.mode("overwrite").parquet(path)


def load_versioned(spark: SparkSession, path: str, version: int) -> DataFrame:
    """Its rows of ``version``; none if it has another."""
    return spark.read.parquet(path).where(F.col("__version") == version).drop("__version")


def through_cache(files: DataFrame, cached: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(findings that the cache has for keys of ``files``, files that need a run).

    A run that found nothing must be cached as one row of its key, or it is run again.
    """
    return cached.join(files.select(key).distinct(), key, "left_semi"), files.join(cached.select(key).distinct(), key, "left_anti")
