"""Weights inside groups: Boltzmann factors, weighted means and moments, cuts of minor weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def boltzmann(rows: DataFrame, group: list[str], energy: str, kt: float) -> DataFrame:
    """rows with weight: exp(-(E - least E) / kT), normalised in each group."""
    w = Window.partitionBy(*group)
    raw = F.exp(-(F.col(energy) - F.min(energy).over(w)) / kt)
    return rows.withColumn("raw", raw).withColumn("weight", F.col("raw") / F.sum("raw").over(w)).drop("raw")


def weighted_mean(rows: DataFrame, group: list[str], x: str, weight: str) -> DataFrame:
    """Long form (group, position, mean): the weighted mean of each component; sums are taken before the shuffle."""
    parts = rows.select(*group, weight, F.posexplode(x).alias("position", "v"))
    return parts.groupBy(*group, "position").agg((F.sum(F.col("v") * F.col(weight)) / F.sum(weight)).alias("mean"))


def moments(rows: DataFrame, group: list[str], x: str, weight: str) -> DataFrame:
    """Long form (group, position, mean, deviation) with |weight| as weights: sqrt(E[v^2] - E[v]^2), 0 where that is negative."""
    parts = rows.select(*group, F.abs(weight).alias("w"), F.posexplode(x).alias("position", "v"))
    sums = parts.groupBy(*group, "position").agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("v")).alias("s"), F.sum(F.col("w") * F.col("v") * F.col("v")).alias("q"))
    mean = F.col("s") / F.col("n")
    return sums.select(*group, "position", mean.alias("mean"), F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0))).alias("deviation"))


def cut_minor(rows: DataFrame, group: list[str], order: list[str], rho: str, remaining: float) -> DataFrame:
    """Normalised weights, least ones cut and a constant taken off the others so that `remaining` of the mass stays; then
    normalised again as `kept`. Rows whose weight goes are left out; ties stand in the order of `order`.

    The others are the longest front of the falling weights for which its last weight times its length, with all weights
    behind it, exceeds 1 - remaining: so a window's rank and sums find it, without a loop. A single row keeps weight 1.
    """
    all_ = Window.partitionBy(*group)
    falling = all_.orderBy(F.desc("share"), *order)
    share = rows.withColumn("share", F.col(rho) / F.sum(rho).over(all_))
    ranked = share.withColumn("rank", F.row_number().over(falling)).withColumn("front", F.sum("share").over(falling.rowsBetween(Window.unboundedPreceding, 0)))
    ranked = ranked.withColumn("behind", 1 - F.col("front")).withColumn("n", F.count(F.lit(1)).over(all_))
    passes = F.col("share") * F.col("rank") + F.col("behind") > 1 - remaining
    length = ranked.withColumn("length", F.max(F.when(passes, F.col("rank"))).over(all_))
    cut = F.max(F.when(F.col("rank") == F.col("length"), (1 - remaining - F.col("behind")) / F.col("length"))).over(all_)
    left = length.withColumn("cut", F.when(F.col("n") > 1, cut).otherwise(0.0)).filter(F.col("rank") <= F.col("length"))
    lowered = left.withColumn("lowered", F.greatest(F.col("share") - F.col("cut"), F.lit(0.0)))
    return lowered.withColumn("kept", F.col("lowered") / F.sum("lowered").over(all_)).drop("share", "rank", "front", "behind", "n", "length", "cut", "lowered")
