"""Scores from findings: noisy-OR health, geometric-mean composite, impact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Damage of the worst severity of a group.
SEVERITY = {"error": 0.7, "warning": 0.4, "info": 0.12}
MAX_DAMAGE, FLOOR = 0.85, 0.02


def damage(findings: DataFrame) -> DataFrame:
    """Damage of each (category, analyzer): severity x confidence x importance x deviation x sample, at most 0.85."""
    sev = F.coalesce(*(F.when(F.col("severity") == k, v) for k, v in SEVERITY.items()), F.lit(0.0))
    out = findings.groupBy("category", "analyzer").agg(F.max(sev).alias("sev"), F.avg("confidence").alias("conf"), F.max("importance").alias("imp"), F.avg("deviation").alias("dev"), F.count("*").alias("n"))
    return out.select("category", "analyzer", "n", F.least(F.lit(MAX_DAMAGE), F.col("sev") * F.col("conf") * F.col("imp") * F.col("dev") * F.least(F.lit(1.0), F.col("n") / 8)).alias("damage"))


def health(damages: DataFrame) -> DataFrame:
    """Noisy-OR health of each category: the product of 1 - damage."""
    return damages.groupBy("category").agg(F.product(1 - F.col("damage")).alias("health"), F.count("*").alias("analyzers"))


def composite(healths: DataFrame) -> DataFrame:
    """Geometric mean of the healths, 0 to 100; 100 without any category."""
    score = 100 * F.exp(F.avg(F.log(F.greatest(F.lit(FLOOR), F.col("health")))))
    return healths.agg(F.count("*").alias("categories"), F.coalesce(F.floor(score * 10 + 0.5) / 10, F.lit(100.0)).alias("composite"))


def leave_one_out(damages: DataFrame) -> DataFrame:
    """Health of the category without each analyzer, and the gain: survival divided by the own factor."""
    w = Window.partitionBy("category")
    whole = F.exp(F.sum(F.log1p(-F.col("damage"))).over(w))
    return damages.select("category", "analyzer", whole.alias("health"), (whole / (1 - F.col("damage"))).alias("health_without")).withColumn("impact", F.col("health_without") - F.col("health"))


def ecdf(rows: DataFrame, cohort: str, value: str, at: Column) -> DataFrame:
    """Percentile of ``at`` among the values of each cohort."""
    return rows.groupBy(cohort).agg(F.count("*").alias("n"), F.round(100 * F.count_if(F.col(value) <= at) / F.count("*"), 1).alias("percentile"))


def stack_evidence(rows: DataFrame, keys: list[str], confidence: str) -> DataFrame:
    """Joint confidence of independent rules: summed log-odds, confidences clamped to .01 to .99, at most .999."""
    c = F.least(F.lit(0.99), F.greatest(F.lit(0.01), F.col(confidence)))
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.log(c / (1 - c))).alias("odds")).select(*keys, "n", F.least(F.lit(0.999), 1 / (1 + F.exp(-F.col("odds")))).alias("stacked"))


def poisson_tail(k: Column, rate: Column) -> Column:
    """P(X >= k) of a Poisson variable."""
    terms = F.aggregate(F.sequence(F.lit(1), k.cast("int") - 1), F.struct(F.exp(-rate).alias("t"), F.exp(-rate).alias("s")), lambda a, i: F.struct((a["t"] * rate / i).alias("t"), (a["s"] + a["t"] * rate / i).alias("s")))
    return F.when(k <= 0, 1.0).when(k == 1, 1 - F.exp(-rate)).otherwise(F.greatest(F.lit(0.0), 1 - terms["s"]))


# Scales of the deviation of count-based findings, the credit of a category without a finding, full samples.
DEVIATION_FLOOR, DUP_SCALE, RATE_SCALE, DENSITY_SCALE = 0.05, 0.15, 0.5, 2.0
NO_FINDING_PRIOR, EVIDENCE_LINES, FULL_SAMPLE = 0.8, 2500, 8


def group_deviation(functions: int, kloc: float) -> Column:
    """Deviation of a group of findings, an aggregate over consistency, dup_size, importance.

    Votes: the worst share off the convention, at least DEVIATION_FLOOR where there is any. Groups of duplicates:
    redundant copies, weighted by importance, a function. Else findings a function, or a thousand lines where no function is known.
    """
    signals = F.bool_and(F.col("consistency").isNotNull())
    worst = F.greatest(F.lit(0.0), F.max(1 - F.col("consistency") / 100))
    copies = F.sum(F.when(F.col("dup_size") > 1, (F.col("dup_size") - 1) * F.col("importance")).otherwise(0.0))
    rest = 1 - F.exp(-(F.count("*") / functions) / RATE_SCALE) if functions else 1 - F.exp(-(F.count("*") / kloc) / DENSITY_SCALE)
    grouped = F.when(F.bool_or(F.col("dup_size") > 1), 1 - F.exp(-(copies / functions) / DUP_SCALE)).otherwise(rest) if functions else rest
    return F.when(signals, F.when(worst <= 0, 0.0).otherwise(F.greatest(F.lit(DEVIATION_FLOOR), F.least(F.lit(1.0), worst)))).otherwise(grouped)


def detector_damage(findings: DataFrame, functions: int, kloc: float) -> DataFrame:
    """Damage of each (category, analyzer): as ``damage``, with the deviation and the sample taken from the findings.

    The sample is the largest total_relevant, 1 without one; groups of duplicates carry importance in their deviation.
    """
    sev = F.max(F.coalesce(*(F.when(F.col("severity") == k, v) for k, v in SEVERITY.items()), F.lit(0.0)))
    sample = F.when(F.coalesce(F.max("total_relevant"), F.lit(0)) <= 0, 1.0).otherwise(F.least(F.lit(1.0), F.max("total_relevant") / FULL_SAMPLE))
    dup = ~F.bool_and(F.col("consistency").isNotNull()) & F.bool_or(F.col("dup_size") > 1) if functions else F.lit(False)
    imp = F.when(dup, 1.0).otherwise(F.max("importance"))
    return findings.groupBy("category", "analyzer").agg(F.count("*").alias("n"), F.least(F.lit(MAX_DAMAGE), sev * F.avg("confidence") * imp * group_deviation(functions, kloc) * sample).alias("damage"))


def category_scores(damages: DataFrame, categories: DataFrame, lines: int) -> DataFrame:
    """Score of each category (category, weight): weight x health, to a tenth; without a finding the evidence prior."""
    empty = NO_FINDING_PRIOR + (1 - NO_FINDING_PRIOR) * (1 - F.exp(F.lit(-max(0, lines) / EVIDENCE_LINES)))
    h = damages.groupBy("category").agg(F.product(1 - F.col("damage")).alias("health"), F.sum("n").alias("findings"))
    out = categories.join(h, "category", "left")
    return out.select("category", "weight", F.coalesce("findings", F.lit(0)).alias("findings"), (F.floor(F.col("weight") * F.coalesce("health", empty) * 10 + 0.5) / 10).alias("score"))


def file_scores(findings: DataFrame) -> DataFrame:
    """100 x the product over a file's analyzers of 1 - severity x confidence x importance, rounded.

    Halves go up. Products are taken to 9 places first: the order in which a group's rows come changes their last bits.
    """
    sev = F.max(F.coalesce(*(F.when(F.col("severity") == k, v) for k, v in SEVERITY.items()), F.lit(0.0)))
    each = findings.groupBy("path", "analyzer").agg(F.least(F.lit(MAX_DAMAGE), sev * F.avg("confidence") * F.max("importance")).alias("d"), F.count("*").alias("n"))
    return each.groupBy("path").agg(F.sum("n").alias("findings"), F.floor(F.round(100 * F.product(1 - F.col("d")), 9) + 0.5).cast("long").alias("score"))


def zone(drift: Column) -> Column:
    return F.when(drift < 0.25, "green").when(drift < 0.5, "yellow").otherwise("red")


def gauge(scope: Column, convention: Column, redundancy: Column) -> Column:
    """Noisy-OR of the shares of three kinds of flags, to a thousandth."""
    clamp = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
    return F.floor((1 - (1 - 0.5 * clamp(scope)) * (1 - 0.35 * clamp(convention)) * (1 - 0.4 * clamp(redundancy))) * 1000 + 0.5) / 1000


def held_zone(last: Column, drift: Column, margin: float = 0.05) -> Column:
    """The next zone: a boundary counts only when it is passed by a margin."""
    raw = zone(drift)
    stay = ((last == "green") & (raw == "yellow") & (drift < 0.25 + margin)) | ((last == "yellow") & (raw == "red") & (drift < 0.5 + margin)) | ((last == "yellow") & (raw == "green") & (drift > 0.25 - margin)) | ((last == "red") & (raw == "yellow") & (drift > 0.5 - margin))
    return F.when(stay, last).otherwise(raw)
