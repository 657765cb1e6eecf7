"""Analytics of runs: visits(replica, step, key, f), one row for each step that a replica visited a state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import staged


def visit_counts(visits: DataFrame) -> DataFrame:
    return visits.groupBy("key", "replica").agg(F.count(F.lit(1)).alias("visits"))


def first_encounters(visits: DataFrame) -> DataFrame:
    """Each state's first step, and the smallest replica that was there then."""
    first = visits.groupBy("key").agg(F.min(F.struct("step", "replica")).alias("m"))
    return first.select("key", F.col("m.step").alias("first_step"), F.col("m.replica").alias("first_replica"))


def merged_histograms(*histories: DataFrame) -> DataFrame:
    """Histories (key, replica, step) as one: (key, replica, visits, first, last, step_sum).

    Steps stay rows, so that a state with very many visits is never one list; sums start inside tasks.
    """
    both = histories[0]
    for other in histories[1:]:
        both = both.unionByName(other)
    return both.groupBy("key", "replica").agg(F.count(F.lit(1)).alias("visits"), F.min("step").alias("first"), F.max("step").alias("last"), F.sum("step").alias("step_sum"))


def bias(visits: DataFrame, coefficient: float) -> DataFrame:
    """(key, beta_class, bias): coefficient times the visits of all replicas of one class (with one beta) in each state."""
    return visits.groupBy("key", "beta_class").agg((F.count(F.lit(1)) * coefficient).alias("bias"))


def forward_filled(visits: DataFrame, steps: Column) -> DataFrame:
    """(replica, step, key) for every step up to the last, each with the state that the replica was in; NULL before its first.

    A visit becomes the stretch of steps up to the next one, so no grid of steps is joined.
    """
    last = visits.agg(F.max("step").alias("last"))
    start = visits.select("replica").distinct().select("replica", steps.alias("step"), F.lit(None).cast("string").alias("key"))
    known = visits.filter(F.col("step") >= steps).select("replica", "step", "key")
    both = known.unionByName(start.join(known, ["replica", "step"], "left_anti"))
    following = F.lead("step").over(Window.partitionBy("replica").orderBy("step"))
    ends = both.withColumn("next", following).join(F.broadcast(last))
    return ends.select("replica", F.explode(F.sequence(F.col("step"), F.coalesce(F.col("next") - 1, F.col("last")))).alias("step"), "key")


def running(visits: DataFrame) -> DataFrame:
    """Each step of a replica with its best value so far and the number of states it has found."""
    order = Window.partitionBy("replica").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    new = (F.row_number().over(Window.partitionBy("replica", "key").orderBy("step")) == 1).cast("long")
    return visits.withColumn("new", new).select("replica", "step", F.min("f").over(order).alias("best"), F.sum("new").over(order).alias("found"))


def run_lengths(visits: DataFrame) -> DataFrame:
    """Steps with the number of steps since the state last changed (0 at a change)."""
    order = Window.partitionBy("replica").orderBy("step")
    moved = F.coalesce((F.lag("key").over(order) != F.col("key")).cast("int"), F.lit(1))
    islands = visits.withColumn("moved", moved).withColumn("island", F.sum("moved").over(order))
    return islands.withColumn("waited", F.row_number().over(Window.partitionBy("replica", "island").orderBy("step")) - 1).drop("moved", "island")


def average_wait(visits: DataFrame) -> DataFrame:
    """The mean of run_lengths over all steps of each replica."""
    return run_lengths(visits).groupBy("replica").agg((F.sum("waited") / F.count(F.lit(1))).alias("average_wait"))


def never_worse(visits: DataFrame) -> DataFrame:
    """Steps at which the least value over replicas exceeds that of the step before: none in a minimising run."""
    least = visits.groupBy("step").agg(F.min("f").alias("least"))
    before = least.select((F.col("step") + 1).alias("step"), F.col("least").alias("before"))
    return least.join(before, "step").filter(F.col("least") > F.col("before"))


def best_candidates(visits: DataFrame, n: int) -> DataFrame:
    """The n states with the least values; NULLs don't count, ties go by key. Only the top n of each task are gathered."""
    states = visits.filter(F.col("f").isNotNull()).groupBy("key").agg(F.min("f").alias("f"))
    return states.orderBy("f", "key").limit(n)


def states(visits: DataFrame) -> DataFrame:
    """(key, f, first_step): each state's least value and the step at which any replica first met it."""
    return visits.groupBy("key").agg(F.min("f").alias("f"), F.min("step").alias("first_step"))


def best_before(visits: DataFrame, n: int, cut: int) -> DataFrame:
    """The n best of the states that were met up to a step; NULLs don't count, ties go by key."""
    met = states(visits).filter((F.col("first_step") <= cut) & F.col("f").isNotNull())
    return met.orderBy("f", "key").limit(n)


def first_acceptances(visits: DataFrame, accepted: Column) -> DataFrame:
    """first_encounters of the steps that were accepted: (key, first_step, first_replica)."""
    return first_encounters(visits.filter(accepted))


def replica_count(visits: DataFrame) -> DataFrame:
    """One row (replicas): one more than the greatest replica that visited anything."""
    return visits.agg((F.coalesce(F.max("replica"), F.lit(-1)) + 1).alias("replicas"))


def triggered(visits: DataFrame, every: int) -> DataFrame:
    """The steps at which something that is due every so many steps happens."""
    return visits.filter(F.col("step") % every == 0)


def evaluations(visits: DataFrame) -> DataFrame:
    """(key, calls, evaluated): how often a state's value was asked for, and the replicas that had to work it out once each."""
    return visits.groupBy("key").agg(F.count(F.lit(1)).alias("calls"), F.count_distinct("replica").alias("evaluated"))


def run_rows(log: DataFrame, *values: str) -> DataFrame:
    """One row for each state of a run's log with all values known: (key, first_step, values at that step)."""
    first = log.groupBy("key").agg(F.min(F.struct("step", "replica", *values)).alias("m"))
    return first.select("key", F.col("m.step").alias("first_step"), *[F.col(f"m.{v}").alias(v) for v in values]).dropna(subset=list(values))


def best_per_seed(visits: DataFrame) -> DataFrame:
    best = visits.filter(F.col("f").isNotNull()).groupBy("replica").agg(F.min(F.struct("f", "step", "key")).alias("m"))
    return best.select("replica", F.col("m.f").alias("f"), F.col("m.step").alias("step"), F.col("m.key").alias("key"))


def spill_cut(states: DataFrame, portion: float) -> DataFrame:
    """states(key, last_used) -> those that are older than the cut: the first time of use up to which more than `portion` of all lie.

    Times of use are counted first, then summed up by ranges, so that no task orders them all.
    """
    counts = states.groupBy("last_used").agg(F.count(F.lit(1)).alias("n"))
    ranged = staged(counts.repartitionByRange("last_used").withColumn("part", F.spark_partition_id()), "uses")
    parts = ranged.groupBy("part").agg(F.sum("n").alias("own"))
    parts = parts.select("part", (F.sum("own").over(Window.orderBy("part")) - F.col("own")).alias("before"), F.sum("own").over(Window.partitionBy()).alias("total"))  # a row for each task
    reach = F.col("before") + F.sum("n").over(Window.partitionBy("part").orderBy("last_used"))
    reached = ranged.join(F.broadcast(parts), "part").withColumn("reach", reach)
    cut = reached.filter(F.col("reach") > F.floor(F.col("total") * portion)).agg(F.min("last_used").alias("cut"))
    return states.join(F.broadcast(cut), F.col("last_used") < F.col("cut")).drop("cut")


def move_statistics(moves: DataFrame) -> DataFrame:
    """moves(kind, valid, accepted) -> attempted, valid and accepted ones of each kind."""
    return moves.groupBy("kind").agg(F.count(F.lit(1)).alias("attempted"), F.count_if("valid").alias("valid"), F.count_if(F.col("valid") & F.col("accepted")).alias("accepted"))


def boltzmann_bins(visits: DataFrame, low: float, high: float, bins: int) -> DataFrame:
    """visits(beta, f) -> for each beta and bin of f: count, mean, deviation, standard error, and the density reweighted to beta 0."""
    width = (high - low) / bins
    put = visits.filter((F.col("f") >= low) & (F.col("f") < high)).withColumn("bin", F.floor((F.col("f") - low) / width))
    mid = F.lit(low) + (F.col("bin") + 0.5) * width
    put = put.withColumn("mid", mid).withColumn("factor", F.exp(F.col("beta") * (F.col("f") - F.col("mid"))))
    sums = put.groupBy("beta", "bin", "mid").agg(F.count(F.lit(1)).alias("n"), F.avg("f").alias("mean"), F.stddev_pop("f").alias("deviation"), F.sum("factor").alias("density"))
    return sums.withColumn("error", F.col("deviation") / F.sqrt("n"))


def bin_deviations(binned: DataFrame) -> DataFrame:
    """log(d / d_ref) + beta (mid - mid_ref) against the lowest bin of each beta: 0 for an exact Boltzmann distribution."""
    ref = binned.groupBy("beta").agg(F.min(F.struct("bin", "mid", "density")).alias("ref"))
    return binned.join(ref, "beta").select("beta", "bin", (F.log(F.col("density") / F.col("ref.density")) + F.col("beta") * (F.col("mid") - F.col("ref.mid"))).alias("deviation"))


def global_histogram(*runs: DataFrame) -> DataFrame:
    """States of all runs once, each with its first step in any."""
    both = runs[0]
    for other in runs[1:]:
        both = both.unionByName(other)
    return both.groupBy("key").agg(F.min("step").alias("first_step"))


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one of two histograms has more often than the other, with which one; none if they are equal."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def two_tier(rows: DataFrame, first_tier: Column, key: str, order: list[str]) -> DataFrame:
    """Distinct keys of the first tier, then of other rows those whose key the first doesn't have; the first row of each."""
    marked = rows.withColumn("tier", F.when(first_tier, 0).otherwise(1))
    by_key = Window.partitionBy(key).orderBy("tier", *order)
    return marked.withColumn("n", F.row_number().over(by_key)).filter("n = 1").drop("n")


def spill(states: DataFrame, portion: float, path: str, dump_id: int) -> DataFrame:
    """Appends the states older than the cut to a table by dump_id, and gives the others."""
    old = spill_cut(states, portion)
    old.withColumn("dump_id", F.lit(dump_id)).write.mode("append").partitionBy("dump_id").parquet(path)
    return states.join(old.select("key"), "key", "left_anti")


def save(log: DataFrame, path: str) -> None:
    """A run's log by run: what a later job needs to go on or to analyse it."""
    log.write.mode("overwrite").partitionBy("replica").parquet(path)


def last_states(log: DataFrame) -> DataFrame:
    """Where each replica of each run stands: the state of its last step."""
    last = log.groupBy("run", "replica").agg(F.max(F.struct("step", "key", "f")).alias("m"))
    return last.select("run", "replica", F.col("m.step").alias("step"), F.col("m.key").alias("key"), F.col("m.f").alias("f"))
