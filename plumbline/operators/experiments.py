"""Statistics of experiments with arms and tasks: cost per pass, cluster bootstrap, non-inferiority, gates, run order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def run_cost(tokens: dict[str, Column], rates: dict[str, float]) -> Column:
    """Sum of tokens times the rate of their kind."""
    total = F.lit(0.0)
    for kind, n in tokens.items():
        total = total + n * F.lit(rates[kind])
    return total


def acceptance(runs: DataFrame, keys: list[str], passed: str, order: str) -> DataFrame:
    """(keys, attempts, passed, flaky): attempts end with the first that passes; flaky if one failed before it."""
    first = F.min(F.when(F.col(passed), F.col(order)))
    seen = runs.groupBy(*keys).agg(first.alias("__first"), F.array_agg(order).alias("__all"))
    attempts = F.when(F.col("__first").isNull(), F.size("__all")).otherwise(F.size(F.filter("__all", lambda x: x <= F.col("__first"))))
    return seen.select(*keys, attempts.cast("long").alias("attempts"), F.col("__first").isNotNull().alias("passed"), (F.col("__first").isNotNull() & (attempts > 1)).alias("flaky"))


def task_sums(runs: DataFrame, task: str, arm: str, cost: str, passed: str) -> DataFrame:
    """(task, arm, cost, passes, runs), all a bootstrap needs of the runs."""
    return runs.groupBy(F.col(task).alias("task"), F.col(arm).alias("arm")).agg(F.sum(cost).alias("cost"), F.sum(F.col(passed).cast("long")).alias("passes"), F.count("*").alias("runs"))


def draws(tasks: DataFrame, rounds: int) -> DataFrame:
    """(round, task, times): tasks drawn with replacement, as many as there are, in each round.

    Draws come from MD5 of round and place, so they do not depend on partitions or lost tasks.
    """
    n = F.count("*").over(Window.partitionBy())
    numbered = tasks.select("task").distinct().select("task", (F.row_number().over(Window.orderBy("task")) - 1).cast("long").alias("i"), n.alias("n"))
    place = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("round").cast("string"), F.col("i").cast("string"))), 1, 8), 16, 10).cast("long") % F.col("n")
    drawn = numbered.select("i", "n", F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round")).select("round", place.alias("i")).groupBy("round", "i").agg(F.count("*").alias("times"))
    return drawn.join(numbered.select("i", "task"), "i").select("round", "task", "times")


def contrasts(sums: DataFrame, treated: str, against: list[str], rounds: int = 2000, margin: float = 0.05) -> DataFrame:
    """One row for each arm in ``against``: cost ratio, success difference, their 95 % intervals and the verdicts.

    Tasks are the unit that is resampled. A round whose ratio is not finite is left out of the ratio's interval.
    """
    drawn = draws(sums, rounds).join(sums, "task").groupBy("round", "arm").agg(*(F.sum(F.col(c) * F.col("times")).alias(c) for c in ("cost", "passes", "runs")))
    point = sums.groupBy("arm").agg(*(F.sum(c).alias(c) for c in ("cost", "passes", "runs"))).withColumn("round", F.lit(0))
    all_ = drawn.unionByName(point).select("round", "arm", F.when(F.col("passes") > 0, F.col("cost") / F.col("passes")).alias("ecpp"), (F.col("passes") / F.col("runs")).alias("rate"))
    base = all_.where(F.col("arm") == treated).select("round", F.col("ecpp").alias("t_ecpp"), F.col("rate").alias("t_rate"))
    pairs = all_.where(F.col("arm").isin(against)).join(base, "round").select("arm", "round", F.when(F.col("ecpp") > 0, F.col("t_ecpp") / F.col("ecpp")).alias("ratio"), (F.col("rate") - F.col("t_rate")).alias("diff"))
    boot = F.col("round") > 0
    at = lambda c, q: F.percentile(F.when(boot, F.col(c)), q)
    out = pairs.groupBy("arm").agg(
        F.max(F.when(~boot, F.col("ratio"))).alias("ratio"), at("ratio", 0.025).alias("ratio_low"), at("ratio", 0.975).alias("ratio_high"), F.count(F.when(boot, F.col("ratio"))).alias("rounds_used"),
        F.max(F.when(~boot, F.col("diff"))).alias("diff"), at("diff", 0.025).alias("diff_low"), at("diff", 0.975).alias("diff_high"),
    )
    return out.withColumn("not_inferior", F.col("diff_high") <= margin).withColumn("wins", F.coalesce(F.col("not_inferior") & (F.col("ratio_high") < 1), F.lit(False)))
