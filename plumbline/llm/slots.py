"""Sharding by fixed virtual slots, in DataFrame functions alone.

Rows hash to a fixed number of virtual slots; bytes are added up for each slot; a
versioned map assigns slots to shards. Rebalancing edits the map: a few slots
move, the rows' hashes never change. Rows with equal texts share a slot, unless the
copies of one text hold more than a whole shard's share: such a text is dealt by key over the
fewest slots that hold no more than a share each. Slot tables have SLOTS rows, whatever the input.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm.common import materialise, shared_dir

SLOTS = 4096
#: Parts that the rows of a slot are numbered in, so that no slot is one task's.
PARTS = 16


def with_slots(docs: DataFrame, shards: int, slots: int = SLOTS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, size, text_crc32, vslot, part): the virtual slot of every row."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = materialise(docs.select(F.col(key).alias("doc_id"), (F.octet_length(t) + F.lit(1)).cast("long").alias("size"), F.crc32(t).cast("long").alias("text_crc32"), F.xxhash64(t).alias("__h")))
    share = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0] / shards
    # texts with over a shard's share of the bytes: fewer than ``shards``
    wide = rows.groupBy("__h", "size").agg((F.count("*") * F.col("size")).alias("bytes")).where(F.col("bytes") > share).select("__h", "size", F.ceil(F.col("bytes") / share).alias("__cuts"))
    own = rows.join(F.broadcast(wide), ["__h", "size"], "left")
    place = F.when(F.col("__cuts").isNotNull(), F.xxhash64("__h", F.pmod(F.xxhash64("doc_id", "__h"), "__cuts"))).otherwise(F.col("__h"))
    return own.select("doc_id", "size", "text_crc32", F.pmod(place, F.lit(slots)).cast("int").alias("vslot"), F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(PARTS)).cast("int").alias("part"))


def slot_loads(slotted: DataFrame) -> DataFrame:
    """(vslot, bytes, n): at most SLOTS rows."""
    return slotted.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))


def _least(loads: Column) -> Column:
    return F.array_position(loads, F.array_min(loads)).cast("int") - 1


def assign(loads: DataFrame, shards: int, version: int = 1) -> DataFrame:
    """A new map (version, vslot, shard): largest slot first, each to the lightest shard.

    The fold runs over one array of at most SLOTS slots. Ties: smaller slot, then
    smaller shard.
    """
    order = F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("b"), F.col("vslot").alias("v"))))
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), shards).alias("load"), F.array().cast("array<struct<vslot:int,shard:int>>").alias("out"))

    def step(acc: Column, e: Column) -> Column:
        to = _least(acc["load"])
        return F.struct(F.transform(acc["load"], lambda x, i: F.when(i == to, x - e["b"]).otherwise(x)).alias("load"), F.concat(acc["out"], F.array(F.struct(e["v"].alias("vslot"), to.alias("shard")))).alias("out"))

    folded = loads.agg(order.alias("o")).select(F.aggregate("o", start, step)["out"].alias("out"))
    return folded.select(F.explode("out").alias("e")).select(F.lit(version).alias("version"), "e.vslot", "e.shard")


def rebalance(slot_map: DataFrame, loads: DataFrame, shards: int, tolerance: float = 0.02) -> DataFrame:
    """The next version of a map, for ``shards`` shards and new loads.

    Shards keep their slots in falling size while they fit under the mean load plus
    ``tolerance``; the other slots, those of shards that are gone and new slots go, largest
    first, to the lightest shard.
    """
    known = loads.join(F.broadcast(slot_map.select("vslot", "shard")), "vslot", "left")
    mean = (loads.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0] / shards) * (1 + tolerance)
    version = (slot_map.agg(F.max("version")).first()[0] or 0) + 1
    run = F.sum("bytes").over(Window.partitionBy("shard").orderBy(F.desc("bytes"), "vslot"))
    stay = known.withColumn("run", run).withColumn("stays", F.coalesce((F.col("shard") < shards) & (F.col("run") <= mean), F.lit(False)))
    stay = materialise(stay)
    base = {r["shard"]: r["b"] for r in stay.where("stays").groupBy("shard").agg(F.sum("bytes").alias("b")).collect()}
    order = F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("b"), F.col("vslot").alias("v"))))
    start = F.struct(F.array(*(F.lit(base.get(i, 0)).cast("long") for i in range(shards))).alias("load"), F.array().cast("array<struct<vslot:int,shard:int>>").alias("out"))

    def step(acc: Column, e: Column) -> Column:
        to = _least(acc["load"])
        return F.struct(F.transform(acc["load"], lambda x, i: F.when(i == to, x - e["b"]).otherwise(x)).alias("load"), F.concat(acc["out"], F.array(F.struct(e["v"].alias("vslot"), to.alias("shard")))).alias("out"))

    moved = stay.where("not stays").agg(order.alias("o")).select(F.explode(F.aggregate("o", start, step)["out"]).alias("e")).select("e.vslot", "e.shard")
    return stay.where("stays").select("vslot", "shard").unionByName(moved).select(F.lit(version).alias("version"), "vslot", "shard")


def store_map(slot_map: DataFrame, path: str) -> None:
    """Append a version of the map to the store; versions are partitions."""
    slot_map.write.mode("append").partitionBy("version").parquet(path)


def load_map(spark, path: str, version: int | None = None) -> DataFrame:
    """A version of the map, by default the latest."""
    maps = spark.read.schema("vslot int, shard int, version int").parquet(path)
    version = maps.agg(F.max("version")).first()[0] if version is None else version
    return maps.where(F.col("version") == version).select("version", "vslot", "shard")


def current_map(loads: DataFrame, shards: int, store: str) -> DataFrame:
    """The map in force for these loads: the store's latest version, edited where it does not fit, or a first version.

    A version is written before it is used, so every reader of the store deals alike.
    """
    spark = loads.sparkSession
    try:
        last = load_map(spark, store)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        store_map(assign(loads, shards), store)
    else:
        store_map(materialise(rebalance(last, loads, shards)), store)
    return load_map(spark, store)


def shard(docs: DataFrame, shards: int = 16, slots: int = SLOTS, store: str | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Deal all rows over ``shards`` shards of nearly equal bytes.

    Returns doc_id, size (UTF-8 bytes plus 1), text_crc32, law (``bytes``), shard,
    slot (the row's place in its shard, gapless from 0), grown_shard (null under this
    law), virtual_slot and map_version. ``store`` is a folder of map versions in shared storage: its latest map is
    edited for the new loads and the next version stored; by default a new store is begun. Null texts count as empty. Rows that repeat stay, in one
    slot; null keys hash like any value. An empty table gives an empty result; other
    columns are ignored.
    """
    rows = materialise(with_slots(docs, shards, slots, text, key))
    slot_map = current_map(materialise(slot_loads(rows)), shards, store or f"{shared_dir(docs.sparkSession)}/plumbline-slots-{uuid.uuid4().hex}")
    # places: cells (slot, part) have a first place each; SLOTS x PARTS cells at most
    cells = rows.groupBy("vslot", "part").agg(F.count("*").alias("n")).join(F.broadcast(slot_map), "vslot")
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("vslot", "part")) - F.col("n")
    cells = cells.select("vslot", "part", "shard", "version", before.alias("base"))
    within = F.row_number().over(Window.partitionBy("vslot", "part").orderBy("doc_id", "text_crc32", "size")) - 1
    return rows.withColumn("within", within).join(F.broadcast(cells), ["vslot", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("within")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("vslot").alias("virtual_slot"), F.col("version").alias("map_version"))
