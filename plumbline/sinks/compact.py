"""Payloads that are made to fit: what weighs most and is shown least goes first, until the encoded row is small enough."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: files that a deviation keeps once it is cut.
MOST_FILES = 10
SCHEMA = (
    "dna struct<functions:array<string>,groups:array<string>>, findings array<struct<message:string,locations:array<struct<file:string,line:int,snippet:string>>>>, "
    "drifts array<struct<message:string,files:array<string>,truncated:int>>, scores map<string,struct<score:double,findings:int>>, files array<string>"
)
_COLUMNS = ("dna", "findings", "drifts", "scores", "files")


def size(row: DataFrame | None = None) -> Column:
    """Bytes of the row's JSON in UTF-8; null parts are left out of it."""
    return F.octet_length(F.to_json(F.struct(*_COLUMNS)))


def _without_snippets(f: Column) -> Column:
    return f.withField("locations", F.transform(f["locations"], lambda x: x.withField("snippet", F.lit(None).cast("string"))))


def _cut(d: Column) -> Column:
    many = F.size(d["files"]) > MOST_FILES
    return F.when(many, d.withField("truncated", F.size(d["files"])).withField("files", F.slice(d["files"], 1, MOST_FILES))).otherwise(d)


#: In order: what is dropped, the column, where there is something to drop, and what is left.
STEPS: list[tuple[str, str, Callable[[], Column], Callable[[], Column]]] = [
    ("functions", "dna", lambda: F.size(F.col("dna.functions")) > 0, lambda: F.col("dna").withField("functions", F.lit(None).cast("array<string>"))),
    ("snippets", "findings", lambda: F.size("findings") > 0, lambda: F.transform("findings", _without_snippets)),
    ("deviating files", "drifts", lambda: F.size("drifts") > 0, lambda: F.transform("drifts", _cut)),
    ("clean files", "scores", lambda: F.exists(F.map_values("scores"), lambda v: ~(v["findings"] > 0)), lambda: F.map_filter("scores", lambda _, v: v["findings"] > 0)),
    ("files", "files", lambda: F.col("files").isNotNull(), lambda: F.lit(None).cast("array<string>")),
    ("fingerprints", "dna", lambda: F.col("dna").isNotNull(), lambda: F.lit(None).cast("struct<functions:array<string>,groups:array<string>>")),
]


def compact(payloads: DataFrame, target: int) -> DataFrame:
    """``payloads`` (key columns and SCHEMA) with bytes_before, bytes_after and ``trimmed``: the steps taken, in order.

    A step is taken where the row as it then is still exceeds ``target`` bytes and has what the step drops; its size is measured anew after
    each. A row that fits stays as it is; one that no step makes fit is sent with all of them taken. Six projections in one
    plan, no row meets another.
    """
    out = payloads.withColumn("bytes_before", size()).withColumn("bytes_after", F.col("bytes_before")).withColumn("trimmed", F.array().cast("array<string>"))
    for name, column, applies, left in STEPS:
        take = (F.col("bytes_after") > target) & F.coalesce(applies(), F.lit(False))
        out = out.withColumn("__take", take).withColumn(column, F.when(F.col("__take"), left()).otherwise(F.col(column)))
        out = out.withColumn("trimmed", F.when(F.col("__take"), F.array_append("trimmed", F.lit(name))).otherwise(F.col("trimmed"))).withColumn("bytes_after", size()).drop("__take")
    return out
