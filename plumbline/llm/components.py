"""Connected components of an edge table that may be larger than any machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import materialise


def _stars(edges: DataFrame) -> DataFrame:
    """Large star: every larger neighbour of a vertex is linked to its smallest one."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_stars(edges: DataFrame) -> DataFrame:
    """Small star: a vertex and its smaller neighbours are linked to the smallest."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    kept = down.join(low, "a")
    return kept.select("a", F.col("m").alias("b")).unionByName(kept.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(vertex, component) for every vertex of ``edges`` (a, b).

    ``component`` is the smallest vertex that can be reached. Alternating large and
    small stars need about log(n) rounds; each is written to the shared folder. Loops
    and repeated edges are allowed; without edges the result is empty.
    """
    now, before = materialise(edges.select("a", "b").where("a <> b").distinct()), None
    for _ in range(rounds):
        now = materialise(_small_stars(_stars(now)))
        size = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if size == before:
            break
        before = size
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    star = now.select(F.col("a").alias("vertex"), F.col("b").alias("component"))
    return star.unionByName(star.select(F.col("component").alias("vertex"), "component").distinct())
