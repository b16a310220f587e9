"""Session operators over event streams and over tables of the same events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENT_SCHEMA = T.StructType([T.StructField("aid", T.StringType()), T.StructField("sid", T.StringType()), T.StructField("ts", T.TimestampType()), T.StructField("type", T.StringType()), T.StructField("file", T.StringType()), T.StructField("category", T.StringType())])


def cooldown(events: DataFrame, keys: list[str], ts: str, ident: str, seconds: float) -> DataFrame:
    """Events at least ``seconds`` after the last *kept* event of their key.

    Whether an event is kept depends on the last kept one, so each key is a fold: the keys'
    sorted events arrive in batches, and one number is carried over.
    """
    schema = ", ".join(f"{c} {events.schema[c].dataType.simpleString()}" for c in [*keys, ident])
    rows = events.select(*keys, ident, F.unix_micros(F.col(ts).cast("timestamp")).alias("__us")).repartition(*keys).sortWithinPartitions(*keys, "__us", ident)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, last = None, 0
        for part in parts:
            keep = []
            for row in part.itertuples(index=False):
                now = tuple(row[: len(keys)])
                kept = now != key or row[-1] - last >= seconds * 1e6
                if kept:
                    key, last = now, row[-1]
                keep.append(kept)
            yield part.loc[keep, [*keys, ident]]

    return rows.mapInPandas(run, schema)


def read_ledger(spark: SparkSession, path: str, streaming: bool = True) -> DataFrame:
    """Events of JSON-lines ledgers; corrupt lines go."""
    reader = (spark.readStream if streaming else spark.read).schema(T.StructType([*EVENT_SCHEMA.fields, T.StructField("_corrupt_record", T.StringType())]))
    rows = reader.option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return rows.where("_corrupt_record is null and aid is not null").drop("_corrupt_record")


def open_findings(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Flags and resolutions of each (session, file, category), repeated deliveries counted once."""
    unique = events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["aid"]) if events.isStreaming else events.dropDuplicates(["aid"])
    return unique.where("type in ('flag', 'resolve')").groupBy("sid", "file", "category").agg(F.count_if(F.col("type") == "flag").alias("raised"), F.count_if(F.col("type") == "resolve").alias("resolved"), F.max_by("type", "ts").alias("state"))
