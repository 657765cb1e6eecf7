"""Queries on runs: visits, waits, candidates, bins, sampling, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import weights
from ..operators import trajectories as T
from ..streaming import best as B
from ..streaming import visits as S
from .registry import query, r6
from .tables import VISITS, load, visit_rows


@query(f"WITH {VISITS} SELECT key, replica, count(*) AS visits FROM t GROUP BY key, replica")
def visit_counts(spark, sf_dir):
    return T.visit_counts(visit_rows(spark, sf_dir))


@query(f"""WITH {VISITS}, r AS (SELECT key, step, replica, row_number() OVER (PARTITION BY key ORDER BY step, replica) AS n FROM t)
SELECT key, step AS first_step, replica AS first_replica FROM r WHERE n = 1""")
def first_encounter(spark, sf_dir):
    return T.first_encounters(visit_rows(spark, sf_dir))


@query(f"""WITH {VISITS} SELECT key, replica, count(*) AS visits, CAST(list_sum(list_sort(list(step))) AS BIGINT) AS step_sum, min(step) AS first, max(step) AS last FROM t GROUP BY key, replica""")
def merge_histograms(spark, sf_dir):
    t = visit_rows(spark, sf_dir)
    return T.merged_histograms(*[t.filter(f"step % 2 = {k}").select("key", "replica", "step") for k in (0, 1)])


@query(f"WITH {VISITS} SELECT key, beta_class, round(0.25 * count(*), 6) AS bias FROM t GROUP BY key, beta_class")
def bias_potential(spark, sf_dir):
    return T.bias(visit_rows(spark, sf_dir), 0.25).select("key", "beta_class", r6("bias").alias("bias"))


@query(f"""WITH {VISITS}, s AS (SELECT event_type AS kind, f, lag(f) OVER (PARTITION BY replica ORDER BY step) AS before FROM t)
SELECT kind, count(*) AS attempted, count(*) FILTER (WHERE f >= 5) AS valid, count(*) FILTER (WHERE f >= 5 AND coalesce(f <= before, TRUE)) AS accepted FROM s GROUP BY kind""")
def move_statistics(spark, sf_dir):
    from pyspark.sql import Window

    before = F.lag("f").over(Window.partitionBy("replica").orderBy("step"))
    moves = visit_rows(spark, sf_dir).select(F.col("event_type").alias("kind"), (F.col("f") >= 5).alias("valid"), F.coalesce(F.col("f") <= before, F.lit(True)).alias("accepted"))
    return T.move_statistics(moves)


@query(f"""WITH {VISITS}, q AS (SELECT beta, CAST(floor(f / 10) AS BIGINT) AS bin, f FROM t WHERE f >= 0 AND f < 100 AND beta IS NOT NULL)
SELECT beta, bin, count(*) AS n, round(avg(f), 6) AS mean, round(stddev_pop(f), 6) AS deviation, round(stddev_pop(f) / sqrt(count(*)), 6) AS error,
  round(sum(exp(beta * (f - (10 * bin + 5)))), 6) AS density FROM q GROUP BY beta, bin""")
def boltzmann_bins(spark, sf_dir):
    b = T.boltzmann_bins(visit_rows(spark, sf_dir).filter("beta IS NOT NULL"), 0.0, 100.0, 10)
    return b.select("beta", "bin", "n", r6("mean").alias("mean"), r6("deviation").alias("deviation"), r6("error").alias("error"), r6("density").alias("density"))


@query(f"""WITH {VISITS}, q AS (SELECT beta, CAST(floor(f / 10) AS BIGINT) AS bin, f FROM t WHERE f >= 0 AND f < 100 AND beta IS NOT NULL),
d AS (SELECT beta, bin, 10 * bin + 5 AS mid, sum(exp(beta * (f - (10 * bin + 5)))) AS density FROM q GROUP BY beta, bin),
r AS (SELECT *, first_value(density) OVER w AS d0, first_value(mid) OVER w AS m0 FROM d WINDOW w AS (PARTITION BY beta ORDER BY bin))
SELECT beta, bin, round(ln(density / d0) + beta * (mid - m0), 6) + 0.0 AS deviation FROM r""")
def detailed_balance(spark, sf_dir):
    b = T.boltzmann_bins(visit_rows(spark, sf_dir).filter("beta IS NOT NULL"), 0.0, 100.0, 10)
    return T.bin_deviations(b).select("beta", "bin", r6("deviation").alias("deviation"))


@query(f"""WITH {VISITS}, b AS (SELECT CASE WHEN abs(f - 50) < 3.5 THEN 0 WHEN f < 50 THEN -CAST(floor(abs(f - 50) / 7 - 0.5) AS BIGINT) ELSE CAST(floor(abs(f - 50) / 7 - 0.5) AS BIGINT) END AS bin FROM t)
SELECT bin, count(*) AS n FROM b GROUP BY bin""")
def symmetric_bins(spark, sf_dir):
    return visit_rows(spark, sf_dir).groupBy(V.symmetric_bin(F.col("f") - 50, 7.0).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {VISITS}, few AS (SELECT replica, step, key FROM t WHERE event_id % 3 = 0),
g AS (SELECT r.replica, s.step FROM (SELECT DISTINCT replica FROM few) r, (SELECT unnest(range(1, (SELECT max(step) FROM few) + 1)) AS step) s)
SELECT g.replica, g.step, last_value(key IGNORE NULLS) OVER (PARTITION BY g.replica ORDER BY g.step ROWS UNBOUNDED PRECEDING) AS key FROM g LEFT JOIN few USING (replica, step)""")
def trajectory_ffill(spark, sf_dir):
    return T.forward_filled(visit_rows(spark, sf_dir).filter("event_id % 3 = 0"), F.lit(1).cast("long"))


@query(f"""WITH {VISITS}, n AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY replica, key ORDER BY step) = 1 THEN 1 ELSE 0 END AS new FROM t)
SELECT replica, step, min(f) OVER w AS best, CAST(sum(new) OVER w AS BIGINT) AS found FROM n WINDOW w AS (PARTITION BY replica ORDER BY step ROWS UNBOUNDED PRECEDING)""")
def running_best(spark, sf_dir):
    return T.running(visit_rows(spark, sf_dir))


@query(f"""WITH {VISITS}, m AS (SELECT *, CASE WHEN key = lag(key) OVER (PARTITION BY replica ORDER BY step) THEN 0 ELSE 1 END AS moved FROM t),
i AS (SELECT *, sum(moved) OVER (PARTITION BY replica ORDER BY step) AS island FROM m),
w AS (SELECT replica, row_number() OVER (PARTITION BY replica, island ORDER BY step) - 1 AS waited FROM i)
SELECT replica, round(sum(waited) / count(*), 6) AS average_wait FROM w GROUP BY replica""")
def average_wait(spark, sf_dir):
    return T.average_wait(visit_rows(spark, sf_dir)).select("replica", r6("average_wait").alias("average_wait"))


@query(f"""WITH {VISITS}, l AS (SELECT step, min(f) AS least FROM t GROUP BY step)
SELECT a.step, a.least, b.least AS before FROM l a JOIN l b ON a.step = b.step + 1 WHERE a.least > b.least""")
def monotone_check(spark, sf_dir):
    return T.never_worse(visit_rows(spark, sf_dir)).select("step", "least", "before")


@query(f"WITH {VISITS} SELECT key, min(f) AS f FROM t WHERE f IS NOT NULL GROUP BY key ORDER BY f, key LIMIT 20")
def best_candidates(spark, sf_dir):
    """The best 20 states: the operator is a bounded list."""
    return T.best_candidates(visit_rows(spark, sf_dir), 20)


@query(f"""WITH {VISITS}, r AS (SELECT *, row_number() OVER (PARTITION BY replica ORDER BY f, step, key) AS n FROM t WHERE f IS NOT NULL)
SELECT replica, f, step, key FROM r WHERE n = 1""")
def best_per_seed(spark, sf_dir):
    return T.best_per_seed(visit_rows(spark, sf_dir))


@query(f"""WITH {VISITS}, s AS (SELECT key, max(step) AS last_used FROM t GROUP BY key), c AS (SELECT last_used, count(*) AS n FROM s GROUP BY last_used),
r AS (SELECT last_used, sum(n) OVER (ORDER BY last_used) AS reach, sum(n) OVER () AS total FROM c)
SELECT key, last_used FROM s WHERE last_used < (SELECT min(last_used) FROM r WHERE reach > floor(total * 0.5))""")
def spill_cut(spark, sf_dir):
    return T.spill_cut(visit_rows(spark, sf_dir).groupBy("key").agg(F.max("step").alias("last_used")), 0.5)


@query(f"WITH {VISITS} SELECT DISTINCT key, CAST(dense_rank() OVER (ORDER BY key) - 1 AS BIGINT) AS colour FROM t")
def dense_colours(spark, sf_dir):
    """Dense ranks of distinct keys: keys are made distinct and ranked by ranges, whose sizes are summed."""
    from pyspark.sql import Window

    keys = visit_rows(spark, sf_dir).select("key").distinct().repartitionByRange("key").withColumn("part", F.spark_partition_id())
    sizes = keys.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy("key")) - 1
    return keys.withColumn("inside", inside).join(F.broadcast(before), "part").select("key", (F.col("before") + F.col("inside")).cast("long").alias("colour"))


@query(f"WITH {VISITS} SELECT key, min(step) AS first_step FROM t GROUP BY key")
def global_histogram(spark, sf_dir):
    t = visit_rows(spark, sf_dir)
    return T.global_histogram(t.filter("beta_class < 4"), t.filter("beta_class >= 4"))


@query("""WITH k AS (SELECT doc_id, CASE WHEN lang = 'en' THEN 0 ELSE 1 END AS tier, sha256(text) AS key FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY tier, doc_id) AS n FROM k) SELECT doc_id, tier, key FROM r WHERE n = 1""")
def two_tier_dedup(spark, sf_dir):
    rows = load(spark, sf_dir, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("key"))
    return T.two_tier(rows, F.col("lang") == "en", "key", ["doc_id"]).select("doc_id", "tier", "key")


@query(f"""WITH {VISITS}, a AS (SELECT key, count(*) AS n FROM t WHERE step % 2 = 0 GROUP BY key), b AS (SELECT key, count(*) AS n FROM t WHERE step % 2 = 1 GROUP BY key)
SELECT *, 'left' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'right' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")
def histogram_equality(spark, sf_dir):
    t = visit_rows(spark, sf_dir)
    half = lambda k: t.filter(f"step % 2 = {k}").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return T.differences(half(0), half(1))


@query("""SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS deviation, min(value) AS least, arg_min(event_id, {'v': value, 'i': event_id}) AS least_id,
  max(value) AS most, arg_max(event_id, {'v': value, 'i': -event_id}) AS most_id FROM events GROUP BY event_type""")
def mean_std_extrema(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg("value")).alias("mean"), r6(F.stddev_pop("value")).alias("deviation"), F.min("value").alias("least"), F.min_by("event_id", F.struct("value", "event_id")).alias("least_id"),
        F.max("value").alias("most"), F.max_by("event_id", F.struct("value", -F.col("event_id"))).alias("most_id"),
    )


@query(f"""WITH {VISITS}, s AS (SELECT *, lag(f) OVER (PARTITION BY replica ORDER BY step) AS old FROM t),
c AS (SELECT replica, step, old, f, beta, (event_id % 97 + 0.5) / 97 AS u FROM s WHERE old IS NOT NULL)
SELECT replica, step, CASE WHEN beta IS NULL THEN f < old ELSE beta * (f - old) <= 0 OR -ln(1 - u) > beta * (f - old) END AS accepted FROM c""")
def acceptance_rule(spark, sf_dir):
    from pyspark.sql import Window

    t = visit_rows(spark, sf_dir).withColumn("old", F.lag("f").over(Window.partitionBy("replica").orderBy("step"))).filter("old IS NOT NULL")
    u = (F.col("event_id") % 97 + 0.5) / 97
    return t.select("replica", "step", V.accepted(F.col("beta"), F.col("old"), F.col("f"), F.lit(0.0), u).alias("accepted"))


@query("""WITH w AS (SELECT l_orderkey, l_linenumber, exp(-(l_extendedprice - min(l_extendedprice) OVER o) / 1000 / 5) AS raw FROM lineitem WINDOW o AS (PARTITION BY l_orderkey))
SELECT l_orderkey, l_linenumber, round(raw / sum(raw) OVER (PARTITION BY l_orderkey), 6) AS weight FROM w""")
def boltzmann_weights(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") / 1000).alias("e"))
    return weights.boltzmann(rows, ["l_orderkey"], "e", 5.0).select("l_orderkey", "l_linenumber", r6("weight").alias("weight"))


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, l_quantity / sum(l_quantity) OVER (PARTITION BY l_orderkey) AS share, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
r AS (SELECT *, row_number() OVER f AS rank, 1 - sum(share) OVER (PARTITION BY l_orderkey ORDER BY share DESC, l_linenumber ROWS UNBOUNDED PRECEDING) AS behind FROM s WINDOW f AS (PARTITION BY l_orderkey ORDER BY share DESC, l_linenumber)),
l AS (SELECT *, max(CASE WHEN share * rank + behind > 0.2 + 1e-12 THEN rank END) OVER (PARTITION BY l_orderkey) AS length FROM r),
c AS (SELECT *, CASE WHEN n > 1 THEN max(CASE WHEN rank = length THEN (0.2 - behind) / length END) OVER (PARTITION BY l_orderkey) ELSE 0 END AS cut FROM l),
k AS (SELECT l_orderkey, l_linenumber, greatest(share - cut, 0) AS lowered FROM c WHERE rank <= length)
SELECT l_orderkey, l_linenumber, floor(lowered / sum(lowered) OVER (PARTITION BY l_orderkey) * 1e6 + 0.5001) / 1e6 AS kept FROM k WHERE lowered > 1e-9""")
def cut_minor_weights(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return weights.cut_minor(rows, ["l_orderkey"], ["l_linenumber"], "l_quantity", 0.8).filter("kept > 1e-9").select("l_orderkey", "l_linenumber", (F.floor(F.col("kept") * 1e6 + 0.5001) / 1e6).alias("kept"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag <> 'R' AND l_quantity BETWEEN 5 AND 45 THEN round(0.5 * nullif(l_discount, 0) + 2 * nullif(l_tax, 0), 6) END AS objective FROM lineitem""")
def linear_combination_nulls(spark, sf_dir):
    value = V.linear_combination([(0.5, F.nullif("l_discount", F.lit(0.0))), (2.0, F.nullif("l_tax", F.lit(0.0)))])
    ok = V.constrained(value, F.col("l_returnflag") != "R", V.bounded(F.col("l_quantity"), 5, 45).isNotNull())
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", r6(ok).alias("objective"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, event_type || '=' || CAST(value AS VARCHAR) IS NOT NULL AS known FROM events")
def props_keyvalue(spark, sf_dir):
    from ..sources.text import key_values, typed

    e = load(spark, sf_dir, "events")
    text = F.regexp_replace(F.regexp_replace("props", r'[{}"\s]', ""), ",", " ")
    rows = e.select("event_id", key_values(text, " ", ":").alias("m"), key_values(F.concat("event_type", F.lit("="), F.col("value").cast("string"))).alias("v"), "event_type")
    return rows.select("event_id", *typed(F.col("m"), {"k": "int"}), F.col("v")[F.col("event_type")].isNotNull().alias("known"))


def _stream(spark, sf_dir):
    schema = load(spark, sf_dir, "events").schema
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("f", F.col("value")).withColumn("key", F.col("event_type"))


@query("SELECT event_type AS key, count(*) AS visits, min(value) AS best FROM events GROUP BY event_type")
def stream_visit_counts(spark, sf_dir):
    return S.run_once(spark, S.visit_counts(_stream(spark, sf_dir)), "visit-counts", keys=["key"])


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type AS key, count(*) AS visits FROM events GROUP BY 1, 2")
def stream_daily_counts(spark, sf_dir):
    stream = S.windowed_counts(_stream(spark, sf_dir), "ts", "1 day", "2 days")
    return S.run_once(spark, stream, "daily-counts", keys=["start", "key"])


@query(f"WITH {VISITS} SELECT key, min(f) AS f FROM t WHERE f IS NOT NULL GROUP BY key ORDER BY f, key LIMIT 20")
def stream_best_candidates(spark, sf_dir):
    """The best 20 states of a stream, kept by a stateful operator whose lists are bounded."""
    key = F.concat_ws(":", "event_type", F.floor(F.col("value") / 10).cast("string"))
    return B.best_candidates(spark, _stream(spark, sf_dir).withColumn("key", key), 20)
