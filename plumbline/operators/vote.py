"""Peer-group dominance votes over (group, entity, pattern, ord, weight) rows.

``ord`` breaks every tie: the pattern that was seen first wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

HALF_LIFE_DAYS = 90.0


def temporal_weight(age_days: Column) -> Column:
    """2 * e^(-ln 2 * age / 90); rows without an age weigh 1."""
    return F.when(age_days.isNull(), 1.0).otherwise(2 * F.exp(-F.log(F.lit(2.0)) * F.greatest(age_days, F.lit(0)) / HALF_LIFE_DAYS))


def distribution(rows: DataFrame, group: str | list[str], pattern: str, entity: str, weight: Column | None = None) -> DataFrame:
    """Count, weight and first entity of each pattern in each group."""
    keys = [group] if isinstance(group, str) else group
    weight = F.lit(1.0) if weight is None else weight
    return rows.groupBy(*keys, F.col(pattern).alias("pattern")).agg(F.count("*").alias("cnt"), F.sum(weight).alias("weight"), F.min(entity).alias("first_entity"))


def vote(rows: DataFrame, group: str | list[str], pattern: str, entity: str, weight: Column | None = None, min_group: int = 3, threshold: float = 0.7) -> DataFrame:
    """The dominant pattern of each group, its raw count and its weighted share in percent."""
    return decided(distribution(rows, group, pattern, entity, weight), group, min_group, threshold)


def decided(dist: DataFrame, group: str | list[str], min_group: int = 3, threshold: float = 0.7) -> DataFrame:
    """The vote of each group of a ``distribution``; a null key is a group too."""
    keys = [group] if isinstance(group, str) else group
    best = F.max_by(F.struct("pattern", "cnt", "weight"), F.struct("weight", (-F.col("first_entity")).alias("f")))
    out = dist.groupBy(*keys).agg(F.sum("cnt").alias("total"), F.sum("weight").alias("total_weight"), best.alias("b"))
    share = F.col("b.weight") / F.col("total_weight")
    return out.select(*keys, F.col("b.pattern").alias("dominant"), F.col("b.cnt").alias("dominant_count"), "total", F.floor(share * 100 + 0.5).cast("long").alias("consistency"), ((F.col("total") >= min_group) & (share >= threshold) & (F.col("b.cnt") < F.col("total"))).alias("flagged"))


def deviators(rows: DataFrame, votes: DataFrame, group: str, pattern: str) -> DataFrame:
    """Rows whose pattern is not their group's dominant one, for flagged groups."""
    return rows.join(votes.where("flagged").select(group, "dominant"), group).where(F.col(pattern) != F.col("dominant"))


def seeded_vote(rows: DataFrame, group: str, pattern: str, entity: str, hint: str, confidence: float, boost: float = 1.5) -> DataFrame:
    """A vote in which a declared pattern counts ``boost`` times, or 1 + confidence where unseen."""
    dist = distribution(rows, group, pattern, entity).withColumn("boosted", F.when(F.col("pattern") == hint, F.col("weight") * boost).otherwise(F.col("weight")))
    groups = dist.groupBy(group).agg(F.max(F.when(F.col("pattern") == hint, 1).otherwise(0)).alias("seen"))
    virtual = groups.where("seen = 0").select(group, F.lit(hint).alias("pattern"), F.lit(0).cast("long").alias("cnt"), F.lit(0.0).alias("weight"), F.lit(2**62).cast("long").alias("first_entity"), F.lit(1.0 + confidence).alias("boosted"))
    every = dist.withColumn("first_entity", F.col("first_entity").cast("long")).unionByName(virtual)
    pick = lambda c: F.max_by("pattern", F.struct(c, (-F.col("first_entity")).alias("f")))
    return every.groupBy(group).agg(pick("boosted").alias("dominant"), pick("cnt").alias("raw_dominant"), F.sum("cnt").alias("total")).withColumn("matches_hint", F.col("raw_dominant") == hint)


def entropy_gate(rows: DataFrame, group: str, pattern: str, limit: float = 0.8) -> DataFrame:
    """Shannon entropy of each group's patterns; near-uniform groups have no convention."""
    return gated(rows.groupBy(group, pattern).count(), group, limit)


def gated(dist: DataFrame, group: str, limit: float = 0.8) -> DataFrame:
    """The entropy gate of rows that are counted by group and pattern (``count``)."""
    w = Window.partitionBy(group)
    p = F.col("count") / F.sum("count").over(w)
    out = dist.withColumn("p", p).groupBy(group).agg(F.sum("count").alias("total"), F.count("*").alias("k"), F.sum(-F.col("p") * F.log2("p")).alias("entropy"), F.max("p").alias("top"))
    ratio = F.when(F.col("k") < 2, F.lit(0.0)).otherwise(F.col("entropy") / F.log2("k"))
    none = (F.col("k") >= 2) & (ratio > limit)
    conf = F.when(F.col("k") < 2, 0.9).when(none, 0.75).otherwise(F.least(F.lit(0.9), F.greatest(F.lit(0.3), 1 - ratio)))
    return out.select(group, "total", "k", F.round("entropy", 6).alias("entropy"), none.alias("no_convention"), F.round(conf, 6).alias("confidence"), F.floor(F.col("top") * 100 + 0.5).cast("long").alias("score"))


def pivot(rows: DataFrame, group: str, pattern: str, age: Column, days: int = 90, least: int = 3, recent_share: float = 0.7, legacy_share: float = 0.6) -> DataFrame:
    """Groups whose recent rows agree on another pattern than their legacy rows."""
    dist = rows.groupBy(group, F.col(pattern).alias("pattern")).agg(F.count_if(age <= days).alias("recent"), F.count_if(age > days).alias("legacy"))
    pick = lambda c: F.max_by(F.struct("pattern", c), F.struct(c, F.col("pattern")))
    out = dist.groupBy(group).agg(pick("recent").alias("r"), pick("legacy").alias("l"), F.sum("recent").alias("n_recent"), F.sum("legacy").alias("n_legacy"))
    hit = (F.col("n_recent") >= least) & (F.col("n_legacy") >= least) & (F.col("r.recent") >= recent_share * F.col("n_recent")) & (F.col("l.legacy") >= legacy_share * F.col("n_legacy")) & (F.col("r.pattern") != F.col("l.pattern"))
    return out.select(group, F.col("r.pattern").alias("recent_dominant"), F.col("l.pattern").alias("legacy_dominant"), "n_recent", "n_legacy", hit.alias("pivoted"))
