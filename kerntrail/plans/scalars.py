"""Queries on scalars, lists, states and samples: gates, masks, paddings, ladders of states, searches by gradients."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import vectors as V
from ..operators import records as R
from ..operators import search, selection, widths
from ..operators import trajectories as T
from ..sources import text as X
from .registry import blocks, query, r6
from .tables import VECTORS, VISITS, load, vector_rows, visit_rows


@query("SELECT l_orderkey, l_linenumber, l_linenumber <= 5 AND floor(l_quantity / 8) <= 5 AND l_extendedprice / 100 < 500 AND 100 * l_tax < 5 AND round(100 * l_discount) <= 5 AND l_suppkey % 3 > 0 AS passed FROM lineitem")
def property_gate(spark, sf_dir):
    c = F.col
    passed = S.gate(c("l_linenumber"), F.floor(c("l_quantity") / 8), c("l_extendedprice") / 100, 100 * c("l_tax"), F.round(100 * c("l_discount")), c("l_suppkey") % 3)
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", passed.alias("passed"))


@query("SELECT n_nationkey, upper(n_name[1]) || lower(n_name[2:]) AS name FROM nation")
def element_case(spark, sf_dir):
    return load(spark, sf_dir, "nation").select("n_nationkey", S.element_case(F.col("n_name")).alias("name"))


@query("SELECT p_partkey, list_has_any(string_split(p_type, ' '), ['STEEL', 'TIN', 'SMALL', 'ECONOMY']) AS found FROM part")
def any_of_words(spark, sf_dir):
    return load(spark, sf_dir, "part").select("p_partkey", S.any_of(F.split("p_type", " "), ["STEEL", "TIN", "SMALL", "ECONOMY"]).alias("found"))


@query(f"""WITH {VECTORS} SELECT id, round(list_sum(list_transform(list_zip(x, range(64)), lambda t: CASE WHEN (t[2] + id) % 3 = 0 THEN 0 ELSE t[1] END)), 6) AS kept,
  CAST(len(list_filter(range(64), lambda k: (k + id) % 3 = 0)) AS INTEGER) AS taken FROM v""")
def masked_vectors(spark, sf_dir):
    """Every third component ignored, and how many that are."""
    v = vector_rows(spark, sf_dir).withColumn("mask", F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: (k + F.col("id")) % 3 == 0))
    x, mask = F.col("x"), F.col("mask")
    return v.select("id", r6(V.total(S.masked(x, mask))).alias("kept"), F.size(S.selected(x, mask)).alias("taken"))


@query(f"""WITH {VECTORS}, f AS (SELECT id, x[1:15] AS f FROM v), c AS (SELECT id, unnest(range(6)) AS i, f FROM f), p AS (SELECT id, i, unnest(range(6)) AS j, f FROM c),
e AS (SELECT id, i, j, CASE WHEN i = j THEN 0 ELSE f[least(i, j) * 6 - least(i, j) * (least(i, j) + 1) // 2 + greatest(i, j) - least(i, j)] END AS v FROM p)
SELECT id, CAST(i AS INTEGER) AS i, round(sum(v), 6) + 0.0 AS total FROM e GROUP BY id, i""")
def square_form(spark, sf_dir):
    """Fifteen components as the upper triangle of a symmetric matrix of six rows: its rows' sums."""
    rows = vector_rows(spark, sf_dir).select("id", S.square_form(F.slice("x", 1, 15), F.lit(6)).alias("m"))
    return rows.select("id", F.posexplode("m").alias("i", "r")).select("id", "i", r6(V.total(F.col("r"))).alias("total"))


@query(f"""WITH {VECTORS} SELECT id, 5 AS rows, 20 AS width, round(list_sum(x), 6) AS total, round(list_sum(list_concat(x[1:10], x[17:26], x[33:42])), 6) AS part FROM v""")
def padded_matrix(spark, sf_dir):
    """Matrices of four rows of 16 numbers, padded to 5 x 20 and cut to 3 x 10."""
    m = F.transform(F.array(*[F.lit(k) for k in (1, 17, 33, 49)]), lambda k: F.slice("x", k, F.lit(16)))
    sized = vector_rows(spark, sf_dir).select("id", S.padded_matrix(m, 5, 20).alias("wide"), S.padded_matrix(m, 3, 10).alias("small"))
    total = lambda c: r6(V.total(F.flatten(c)))
    return sized.select("id", F.size("wide").alias("rows"), F.size(F.get("wide", F.lit(4))).alias("width"), total("wide").alias("total"), total("small").alias("part"))


@query("SELECT o_orderkey, round(o_totalprice * 27.211386245988, 4) AS ev, round(o_totalprice * 627.5094740631, 2) AS kcal, round(o_totalprice * 0.529177210903, 6) AS angstrom FROM orders")
def unit_conversion(spark, sf_dir):
    e = F.col("o_totalprice")
    return load(spark, sf_dir, "orders").select("o_orderkey", F.round(e * V.HARTREE_IN_EV, 4).alias("ev"), F.round(e * V.HARTREE_IN_KCAL, 2).alias("kcal"), F.round(e * V.BOHR_IN_ANGSTROM, 6).alias("angstrom"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity BETWEEN 5 AND 45 THEN round(l_quantity * pow(1 + l_discount, 3), 6) END AS objective FROM lineitem")
def powered_combination(spark, sf_dir):
    value = S.powered(F.col("l_quantity"), 1 + F.col("l_discount"), 3, 5, 45)
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", r6(value).alias("objective"))


@query(f"""WITH {VECTORS}, d AS (SELECT v.id, list_distance(v.x, o.x) AS d FROM v, (SELECT x FROM v WHERE id = 0) o)
SELECT id, round(pow(CASE WHEN d < 0.8 THEN 0.8 - d WHEN d > 1.3 THEN d - 1.3 ELSE 0 END, 2) - 2, 6) AS well, round(20 * pow(d - 1.1, 2) - 2, 6) AS sharp, round(2 * exp(-1.1 * d), 6) AS decay FROM d""")
def target_potentials(spark, sf_dir):
    """Radial potentials of the distance to one vector."""
    v = vector_rows(spark, sf_dir)
    target = F.broadcast(v.filter("id = 0").select(F.col("x").alias("target")))  # one row
    d = F.sqrt(V.sqdist(F.col("x"), F.col("target")))
    rows = v.join(target).select("id", d.alias("d"))
    return rows.select("id", r6(V.harmonic(F.col("d"), 2.0, 1.3, 0.8)).alias("well"), r6(V.sharp_parabola(F.col("d"), 2.0, 1.1)).alias("sharp"), r6(V.exponential(F.col("d"), 2.0, 1.1)).alias("decay"))


@query("SELECT o_orderkey, round(o_totalprice - o_custkey, 2) AS difference FROM orders")
def property_difference(spark, sf_dir):
    """Two named values of a text and their difference."""
    orders = load(spark, sf_dir, "orders")
    text = F.concat(F.lit("first : "), F.col("o_custkey").cast("string"), F.lit("\nother: x\nsecond : "), F.format_string("%.2f", "o_totalprice"))
    return orders.select("o_orderkey", F.round(X.named_value(text, "second") - X.named_value(text, "first"), 2).alias("difference"))


@query("""WITH k AS (SELECT event_id, value, event_id % 7 = 0 OR value < 5 AS gap FROM events) SELECT event_id, CAST(row_number() OVER (ORDER BY event_id) - 1 AS BIGINT) AS place FROM k WHERE NOT gap""")
def complete_rows(spark, sf_dir):
    """Rows without gaps, numbered anew; values under 5 are taken as unknown, and a seventh as not numbers."""
    value = F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).when(F.col("value") >= 5, F.col("value"))
    rows = load(spark, sf_dir, "events").select("event_id", value.alias("value"))
    return R.renumbered(R.complete(rows, "value"), "event_id", "place").select("event_id", "place")


@query("SELECT c_custkey FROM customer ANTI JOIN orders ON c_custkey = o_custkey")
def rows_without(spark, sf_dir):
    """Customers that no order names."""
    ids = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return R.without(load(spark, sf_dir, "customer"), ids, "c_custkey").select("c_custkey")


@query("""WITH e AS (SELECT l_orderkey AS id, max(l_extendedprice / 1000) AS neutral, min(l_extendedprice / 1000) AS other FROM lineitem GROUP BY 1)
SELECT id, round((neutral - other) * 27.211386245988, 4) AS energy FROM e""")
def ionisation_energy(spark, sf_dir):
    """Differences of two energies of one molecule, in electronvolts."""
    e = F.col("l_extendedprice") / 1000
    rows = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.max(e).alias("neutral"), F.min(e).alias("other"))
    return rows.select("id", F.round((F.col("neutral") - F.col("other")) * V.HARTREE_IN_EV, 4).alias("energy"))


# states of runs


@query(f"WITH {VISITS}, s AS (SELECT key, min(f) AS f, min(step) AS first_step FROM t GROUP BY key) SELECT key, f, first_step FROM s WHERE first_step <= 10")
def step_limited(spark, sf_dir):
    return T.states(visit_rows(spark, sf_dir)).filter("first_step <= 10")


@query(f"WITH {VISITS}, s AS (SELECT key, min(f) AS f, min(step) AS first_step FROM t GROUP BY key) SELECT key, f, first_step FROM s WHERE first_step <= 10 ORDER BY f, key LIMIT 10")
def best_before(spark, sf_dir):
    """The ten best states that were met in ten steps: the operator is a bounded list."""
    return T.best_before(visit_rows(spark, sf_dir), 10, 10)


@query(f"""WITH {VISITS}, s AS (SELECT *, lag(f) OVER (PARTITION BY replica ORDER BY step) AS before FROM t),
r AS (SELECT key, step, replica, row_number() OVER (PARTITION BY key ORDER BY step, replica) AS n FROM s WHERE before IS NULL OR f <= before) SELECT key, step AS first_step, replica AS first_replica FROM r WHERE n = 1""")
def first_acceptance(spark, sf_dir):
    before = F.lag("f").over(Window.partitionBy("replica").orderBy("step"))
    t = visit_rows(spark, sf_dir).withColumn("before", before)
    return T.first_acceptances(t, F.col("before").isNull() | (F.col("f") <= F.col("before")))


@query(f"WITH {VISITS} SELECT max(replica) + 1 AS replicas FROM t")
def replica_count(spark, sf_dir):
    return T.replica_count(visit_rows(spark, sf_dir))


@query(f"WITH {VISITS} SELECT replica, step FROM t WHERE step % 10 = 0")
def triggered_steps(spark, sf_dir):
    return T.triggered(visit_rows(spark, sf_dir), 10).select("replica", "step")


@query(f"WITH {VISITS} SELECT key, count(*) AS calls, count(DISTINCT replica) AS evaluated FROM t GROUP BY key")
def evaluation_counts(spark, sf_dir):
    return T.evaluations(visit_rows(spark, sf_dir))


@query(f"""WITH {VISITS}, r AS (SELECT key, step, f, event_id, row_number() OVER (PARTITION BY key ORDER BY step, replica) AS n FROM t) SELECT key, step AS first_step, f, CASE WHEN event_id % 5 > 0 THEN event_id END AS gap FROM r WHERE n = 1 AND event_id % 5 > 0""")
def run_rows(spark, sf_dir):
    """Each state with what was known of it at its first step; states with a gap go."""
    t = visit_rows(spark, sf_dir).withColumn("gap", F.when(F.col("event_id") % 5 > 0, F.col("event_id")))
    return T.run_rows(t, "f", "gap")


@query(f"""WITH {VISITS}, c AS (SELECT key, event_type, count(*) AS n FROM t GROUP BY key, event_type) SELECT key, round(ln(n::DOUBLE / sum(n) OVER (PARTITION BY event_type)), 6) AS log_share FROM c""")
def log_shares(spark, sf_dir):
    """Logarithms of states' shares in their kind."""
    counts = visit_rows(spark, sf_dir).groupBy("key", "event_type").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("event_type").agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(totals), "event_type").select("key", r6(S.log_share(F.col("n"), F.col("total"))).alias("log_share"))


@query(f"""WITH {VISITS}, c AS (SELECT key, event_type, count(*) AS n FROM t GROUP BY key, event_type), p AS (SELECT event_type, n::DOUBLE / sum(n) OVER (PARTITION BY event_type) AS p FROM c)
SELECT event_type, round(sqrt(avg(1 / p - 1)), 6) AS error FROM p GROUP BY event_type""")
def log_ratio_error(spark, sf_dir):
    counts = visit_rows(spark, sf_dir).groupBy("key", "event_type").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("event_type").agg(F.sum("n").alias("total"))
    shares = counts.join(F.broadcast(totals), "event_type").withColumn("p", F.col("n") / F.col("total"))
    return shares.groupBy("event_type").agg(r6(S.log_ratio_error(F.col("p"))).alias("error"))


# searches


@query()
def error_gradients(spark, sf_dir):
    """Squared errors on a half of all rows of the model of the other half, for two halves, and their derivatives by width and ridge."""
    rows = vector_rows(spark, sf_dir).withColumn("y", F.array(F.col("label").cast("double")))
    found = []
    for fold in range(2):
        half = search.Whole(rows).half(fold)
        error, slopes = widths.error_gradient(rows.filter(half), rows.filter(~half), "gaussian", 1.5, 0.1)
        found.append((fold, *[round(float(v), 5) for v in (error, *slopes)]))
    return spark.createDataFrame(found, "fold int, mse double, mse_sigma double, mse_ridge double")


@query()
def gradient_search(spark, sf_dir):
    """Width and ridge by noisy descent and BFGS on halves of all rows."""
    rows = vector_rows(spark, sf_dir).withColumn("y", F.array(F.col("label").cast("double")))
    found = search.gradient_search(rows, steps=2, refine=1, folds=1, sigma=1.5, most=None)
    return found.select("phase", "step", F.round("sigma", 4).alias("sigma"), F.round("ridge", 6).alias("ridge"), F.round("error", 4).alias("error"), "accepted")


@query()
def class_width_search(spark, sf_dir):
    """A width for each third of the components, over an ensemble of random halves of at most 2,000 rows, and the error of all rows with what it found."""
    rows = vector_rows(spark, sf_dir).withColumn("y", F.array(F.col("label").cast("double")))
    n = rows.select(F.size("x")).first()[0]
    classes = [3 * c // n for c in range(n)]
    found = search.gradient_search(rows, steps=3, refine=2, folds=4, sigma=1.5, classes=classes).filter("accepted").orderBy("error").first()
    half = search.Whole(rows).half(0)
    own = [found["widths"][c] for c in classes]
    error, _ = widths.error_gradient(rows.filter(half), rows.filter(~half), "gaussian", own, found["ridge"])
    return spark.createDataFrame([(k, round(w, 4), round(error, 4)) for k, w in enumerate(found["widths"])], "class int, width double, error double")


WIDE = VECTORS + """, e AS (SELECT id, label, unnest(range(1, len(x) + 1)) AS c, unnest(x) AS v FROM v),
d AS (SELECT a.id AS i, b.id AS j, a.label AS l, a.c, pow((a.v - b.v) / (1 + a.c / 10.0::DOUBLE), 2) AS q FROM e a JOIN e b USING (c)),
k AS (SELECT i, j, exp(-sum(q) / 2) AS k FROM d GROUP BY 1, 2)"""


def _widths(rows):
    return [1 + (c + 1) / 10 for c in range(rows.select(F.size("x")).first()[0])]


@query(f"""WITH {WIDE} SELECT i, j, round(k, 6) AS k, round(k * sum(q / (1 + c / 10.0::DOUBLE)) FILTER (WHERE c % 2 = 1), 6) AS odd, round(k * sum(q / (1 + c / 10.0::DOUBLE)) FILTER (WHERE c % 2 = 0), 6) AS even
FROM d JOIN k USING (i, j) WHERE i <= j GROUP BY i, j, k""")
def class_kernel_slopes(spark, sf_dir):
    """Gaussians with a width for each component, and their slopes by the widths of odd and even components."""
    rows = vector_rows(spark, sf_dir)
    own = _widths(rows)
    found = widths.kernel_slopes(rows, "gaussian", own, blocks(rows), [c % 2 for c in range(len(own))])
    return found.select("i", "j", r6("k").alias("k"), r6(F.col("dk")[0]).alias("odd"), r6(F.col("dk")[1]).alias("even"))


@query(f"WITH {WIDE} SELECT CAST(c AS INTEGER) AS component, round(sum((1 + l) * k * q / (1 + c / 10.0::DOUBLE)), 3) AS slope FROM d JOIN k USING (i, j) GROUP BY 1")
def component_slope_sums(spark, sf_dir):
    """For each component the sum of all kernels' slopes by its width, weighted by labels."""
    rows = vector_rows(spark, sf_dir)
    left = rows.select(F.col("id").alias("i"), F.col("x").alias("a"), (1.0 + F.col("label")).alias("u"))
    right = rows.select(F.col("id").alias("j"), F.col("x").alias("b"), F.lit(1.0).alias("c"))
    n = blocks(rows)
    found = widths.weighted_slopes(left, right, "gaussian", _widths(rows), (n, n))
    return spark.createDataFrame([(k + 1, round(float(v), 3)) for k, v in enumerate(found)], "component int, slope double")


@query()
def pivoted_rows(spark, sf_dir):
    """Eight rows, each the one that those before it explain least."""
    found = selection.pivoted(vector_rows(spark, sf_dir), 8)
    return found.select("place", "id", F.round("share", 6).alias("share"))
