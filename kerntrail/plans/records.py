"""Queries on records: filters, lookups, neighbours of states, crossings, hulls, fits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import pairs as P
from ..operators import records as R
from ..operators import ridge
from ..sources.text import matrix_log
from .registry import blocks, query, r6
from .tables import ATOMS, PAIRS, VECTORS, VISITS, atom_rows, bond_rows, load, vector_rows, visit_rows


@query(f"WITH {ATOMS}, o AS (SELECT *, count(*) FILTER (WHERE z <> 6) OVER (PARTITION BY graph) AS others FROM m) SELECT graph, atom, z FROM o WHERE others < 4 OR z <> 6")
def heavy_atom_filter(spark, sf_dir):
    return R.heavy_atoms(atom_rows(spark, sf_dir).select("graph", "atom", "z"), 6)


@query(f"WITH {ATOMS} SELECT graph, atom, z, CAST(row_number() OVER (PARTITION BY graph ORDER BY z DESC, atom) AS INTEGER) AS place FROM m")
def resorted_atoms(spark, sf_dir):
    return R.resorted(atom_rows(spark, sf_dir).select("graph", "atom", "z"))


@query(f"WITH {VISITS} SELECT replica, step, key FROM t WHERE step % 5 = 1")
def subsampled_runs(spark, sf_dir):
    return R.every_nth(visit_rows(spark, sf_dir), "replica", "step", 5).select("replica", "step", "key")


@query(f"""WITH {VISITS}, s AS (SELECT DISTINCT key FROM t WHERE beta_class = 0), k AS (SELECT key, count(*) AS visits FROM t WHERE beta_class <> 0 GROUP BY key)
SELECT s.key, coalesce(k.visits, 0) AS visits, k.visits IS NOT NULL AS known FROM s LEFT JOIN k USING (key)""")
def histogram_lookup(spark, sf_dir):
    t = visit_rows(spark, sf_dir)
    known = t.filter("beta_class <> 0").groupBy("key").agg(F.count(F.lit(1)).alias("visits"))
    return R.looked_up(t.filter("beta_class = 0").select("key").distinct(), known, "visits").fillna(0, ["visits"])


@query(f"""WITH {PAIRS}, q AS (SELECT i, j, sqrt(d2) AS d FROM p WHERE i <> j UNION ALL SELECT j, i, sqrt(d2) FROM p WHERE i <> j),
r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS rank FROM q)
SELECT i AS id, CAST(rank AS INTEGER) AS rank, j AS neighbour, round(d, 6) AS d FROM r WHERE rank <= 4""")
def closest_four(spark, sf_dir):
    v = vector_rows(spark, sf_dir)
    return P.nearest_k(v, 4, blocks(v)).select("id", "rank", "neighbour", r6(F.sqrt("d2")).alias("d"))


@query(f"WITH {PAIRS} SELECT CAST(floor(sqrt(d2) / 0.05) AS BIGINT) AS shell, count(*) AS n FROM p WHERE i < j GROUP BY 1")
def radial_distribution(spark, sf_dir):
    v = vector_rows(spark, sf_dir)
    return P.radial_distribution(v, 0.05, blocks(v))


@query(f"""WITH {VECTORS}, e AS (SELECT pos, x[pos] AS ref, avg(x[pos]) OVER (PARTITION BY label, pos) AS p FROM (SELECT *, unnest(range(1, 65)) AS pos FROM v))
SELECT round(avg(abs(p - ref)), 6) AS mae, count(*) AS cells FROM e WHERE ref <> 0""")
def weighted_mean_mae(spark, sf_dir):
    cells = vector_rows(spark, sf_dir).select("label", F.posexplode("x").alias("column", "ref"))
    means = cells.groupBy("label", "column").agg(F.avg("ref").alias("p"))
    return R.weighted_mean_mae(cells.join(means, ["label", "column"])).select(r6("mae").alias("mae"), "cells")


@query("""WITH l AS (SELECT l_orderkey AS id, max(l_extendedprice / 1000) FILTER (WHERE l_quantity > 25) AS homo, min(l_extendedprice / 1000) FILTER (WHERE l_quantity <= 25) AS lumo FROM lineitem GROUP BY l_orderkey)
SELECT id, round(homo, 6) AS homo, round(lumo, 6) AS lumo, round(lumo - homo, 6) AS gap FROM l""")
def frontier_levels(spark, sf_dir):
    level = F.struct((F.col("l_extendedprice") / 1000).alias("e"), F.when(F.col("l_quantity") > 25, 2.0).otherwise(0.0).alias("o"))
    lists = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(level).alias("s"))
    found = lists.select("id", *R.levels(F.transform("s", lambda x: x["e"]), F.transform("s", lambda x: x["o"])))
    return found.select("id", *[r6(c).alias(c) for c in ("homo", "lumo", "gap")])


@query("SELECT l_orderkey, l_linenumber, round(sqrt(l_quantity * l_quantity + pow(100 * l_discount, 2) + pow(100 * l_tax, 2)), 6) AS dipole FROM lineitem")
def dipole_norm(spark, sf_dir):
    x = F.array(F.col("l_quantity"), 100 * F.col("l_discount"), 100 * F.col("l_tax"))
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", r6(V.norm(x)).alias("dipole"))


@query(f"""WITH RECURSIVE {VISITS}, n AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY replica, key ORDER BY step) = 1 THEN 1 ELSE 0 END AS new FROM t),
c AS (SELECT step AS x, sum(new) OVER (PARTITION BY replica ORDER BY step ROWS UNBOUNDED PRECEDING) AS y FROM n),
s AS (SELECT CAST(x AS DOUBLE) AS x, CAST(count(*) AS DOUBLE) AS n, CAST(sum(y) AS DOUBLE) AS sy FROM c GROUP BY x),
g AS (SELECT (SELECT max(sy / n) FROM s) AS a, (SELECT median(x) FROM s) AS b, 0 AS k UNION ALL
  SELECT a + (w * p - v * q) / (u * w - v * v), b + (u * q - v * p) / (u * w - v * v), k + 1 FROM (
    SELECT a, b, k, sum(n * x * x / pow(b + x, 2)) AS u, sum(-n * a * x * x / pow(b + x, 3)) AS v, sum(n * a * a * x * x / pow(b + x, 4)) AS w,
      sum(x / (b + x) * (sy - n * a * x / (b + x))) AS p, sum(-a * x / pow(b + x, 2) * (sy - n * a * x / (b + x))) AS q
    FROM g, s WHERE k < 60 GROUP BY a, b, k))
SELECT round(a, 4) AS a, round(b, 4) AS b FROM g WHERE k = 60""")
def discovery_saturation(spark, sf_dir):
    from ..operators import trajectories as T

    curve = T.running(visit_rows(spark, sf_dir)).select(F.col("step").alias("x"), F.col("found").alias("y"))
    return R.saturation(curve).select(F.round("a", 4).alias("a"), F.round("b", 4).alias("b"))


@query(f"""WITH {VISITS}, u AS (SELECT key, turn, CAST(CAST('0x' || substr(md5(turn || ':' || event_id), 1, 12) AS BIGINT) AS DOUBLE) / 281474976710656.0::DOUBLE AS u FROM t, (SELECT unnest(range(1, 5)) AS turn)),
f AS (SELECT turn, key, min(u) AS u FROM u GROUP BY turn, key), c AS (SELECT CAST(floor(u * 50) AS BIGINT) + 1 AS bin, count(*) AS n FROM f GROUP BY 1)
SELECT bin, round(sum(n) OVER (ORDER BY bin) / 4, 6) AS found FROM c""")
def discovery_curve(spark, sf_dir):
    """States that parts of all visits hold, on average over four random orders."""
    rows = visit_rows(spark, sf_dir).select(F.col("event_id").alias("id"), "key")
    return R.discovery_curve(rows, 4, 50).select("bin", r6("found").alias("found"))


def _chains(spark, sf_dir):
    c = F.transform(F.array_sort(F.collect_list(F.struct("atom", "z"))), lambda s: s["z"])
    return atom_rows(spark, sf_dir).groupBy("graph").agg(c.alias("chain"))


@query(f"""WITH {ATOMS}, n AS (SELECT graph, count(*) AS n FROM m GROUP BY graph),
k AS (SELECT graph, 'replace' AS kind, 2 * n AS moves FROM n UNION ALL SELECT graph, 'add', 3 FROM n WHERE n < 6 UNION ALL SELECT graph, 'remove', 1 FROM n WHERE n > 1) SELECT * FROM k""")
def possibilities(spark, sf_dir):
    """How many neighbours of each kind every chain has."""
    return R.neighbours(_chains(spark, sf_dir), [6, 7, 8], 6).groupBy("graph", "kind").agg(F.count_distinct("chain").alias("distinct"), F.count(F.lit(1)).alias("moves")).select("graph", "kind", "moves")


@query(f"""WITH {ATOMS}, k AS (SELECT graph, string_agg(CAST(z AS VARCHAR), '-' ORDER BY atom) AS chain, count(*) AS n FROM m GROUP BY graph),
o AS (SELECT o_orderkey AS l, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders)
SELECT o.l AS "left", o.r AS "right", count(*) AS children FROM o JOIN b x ON x.graph = o.l JOIN b y ON y.graph = o.r AND y."order" = x."order" JOIN k ON k.graph = o.r
WHERE x.a + k.n - y.a <= 6 GROUP BY 1, 2""")
def crossings(spark, sf_dir):
    """Children of each customer's consecutive orders."""
    following = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    couples = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("left"), following.alias("right")).filter("right IS NOT NULL")
    found = R.crossings(couples, _chains(spark, sf_dir), bond_rows(atom_rows(spark, sf_dir)), 6)
    return found.groupBy("left", "right").agg(F.count(F.lit(1)).alias("children"))


@query(f"""WITH {ATOMS}, k AS (SELECT graph, string_agg(CAST(z AS VARCHAR), '-' ORDER BY atom) AS chain, count(*) AS n FROM m GROUP BY graph),
u AS (SELECT DISTINCT chain FROM k), s AS (SELECT k.graph, k.chain || '-' || CAST(z AS VARCHAR) AS chain FROM k, (SELECT unnest([6, 7, 8]) AS z) WHERE n < 4)
SELECT s.graph, s.chain FROM s JOIN u USING (chain)""")
def restricted_moves(spark, sf_dir):
    """Additions that lead to a chain that is known already: a semi-join on keys."""
    chains = _chains(spark, sf_dir)
    reached = R.neighbours(chains, [6, 7, 8], 4).filter("kind = 'add'")
    known = chains.select(F.array_join(F.col("chain").cast("array<string>"), "-").alias("chain"))
    return reached.select("graph", F.array_join(F.col("chain").cast("array<string>"), "-").alias("chain")).join(known, "chain", "left_semi").select("graph", "chain")


def _orbitals(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("ao"), (F.col("l_suppkey") % 2).alias("atom"), (F.col("l_partkey") % 3).alias("l"), (F.col("l_discount") + 0.01).alias("c"))


ORBITALS = "o AS (SELECT l_orderkey AS id, l_linenumber AS ao, l_suppkey % 2 AS atom, l_partkey % 3 AS l, l_discount + 0.01::DOUBLE AS c FROM lineitem)"


@query(f"WITH {ORBITALS} SELECT a.id, a.atom = b.atom AS same, a.l AS l1, b.l AS l2, round(sum(a.c * b.c), 6) AS v FROM o a JOIN o b USING (id) GROUP BY 1, 2, 3, 4")
def orbital_representation(spark, sf_dir):
    return R.angular_pairs(_orbitals(spark, sf_dir)).select("id", "same", "l1", "l2", r6("v").alias("v"))


@query(f"WITH {ORBITALS}, p AS (SELECT id, l, sum(c * c) AS p FROM o GROUP BY id, l) SELECT id, l, floor(p / sum(p) OVER (PARTITION BY id) * 1e6 + 0.5001) / 1e6 AS share FROM p")
def angular_populations(spark, sf_dir):
    return R.populations(_orbitals(spark, sf_dir)).select("id", "l", (F.floor(F.col("share") * 1e6 + 0.5001) / 1e6).alias("share"))


@query(f"""WITH {ATOMS} SELECT graph, CAST(sum(CASE z WHEN 6 THEN 4 WHEN 7 THEN 3 ELSE 2 END) AS BIGINT) AS valence, string_agg(CASE z WHEN 6 THEN 'C' WHEN 7 THEN 'N' ELSE 'O' END, '' ORDER BY atom) AS formula FROM m GROUP BY graph""")
def element_lookup(spark, sf_dir):
    valence = F.element_at(V.lookup(V.VALENCES, F.col("z")), 1)
    symbol = V.lookup({z: s for s, z in V.CHARGE.items()}, F.col("z"))
    one = atom_rows(spark, sf_dir).select("graph", "atom", valence.alias("valence"), symbol.alias("s"))
    return one.groupBy("graph").agg(F.sum("valence").alias("valence"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("atom", "s"))), lambda x: x["s"]), "").alias("formula"))


@query("SELECT CAST(o_orderkey AS VARCHAR) || ' ' || CAST(o_custkey AS VARCHAR) || ' ' || printf('%.8E', o_totalprice) AS line FROM orders")
def matrix_log_lines(spark, sf_dir):
    return matrix_log(load(spark, sf_dir, "orders"), "o_orderkey", "o_custkey", value="o_totalprice")


@query(f"""WITH {VISITS} SELECT replica, step, key FROM t WHERE replica IN (SELECT replica FROM t GROUP BY replica HAVING min(f) < 0.5)""")
def converged_runs(spark, sf_dir):
    """Steps of the runs that came under a bound."""
    t = visit_rows(spark, sf_dir)
    good = t.groupBy("replica").agg(F.min("f").alias("least")).filter("least < 0.5")
    return t.join(good, "replica", "left_semi").select("replica", "step", "key")


@query("""WITH p AS (SELECT o_custkey AS v, max(o_totalprice) AS top, min(o_totalprice) AS low FROM orders GROUP BY 1),
s AS (SELECT a.v, a.top, a.low,
  min((a.top - b.top) / (a.v - b.v)) FILTER (WHERE b.v < a.v) AS up_left, max((b.top - a.top) / (b.v - a.v)) FILTER (WHERE b.v > a.v) AS up_right,
  max((a.low - b.low) / (a.v - b.v)) FILTER (WHERE b.v < a.v) AS low_left, min((b.low - a.low) / (b.v - a.v)) FILTER (WHERE b.v > a.v) AS low_right
  FROM p a JOIN p b ON TRUE GROUP BY 1, 2, 3)
SELECT top AS u, CAST(v AS DOUBLE) AS v FROM s WHERE up_left IS NULL OR up_right IS NULL OR up_left > up_right
UNION SELECT low, CAST(v AS DOUBLE) FROM s WHERE low_left IS NULL OR low_right IS NULL OR low_left < low_right""")
def convex_hull(spark, sf_dir):
    """Corners of the hull of orders by price and customer."""
    return R.convex_hull(load(spark, sf_dir, "orders").select(F.col("o_totalprice").alias("u"), F.col("o_custkey").alias("v")))


@query()
def cluster_counts(spark, sf_dir):
    return R.cluster_counts(vector_rows(spark, sf_dir)).select("k", F.round("silhouette", 4).alias("silhouette"), "best")


@query()
def prefix_diversity(spark, sf_dir):
    return R.prefix_diversity(vector_rows(spark, sf_dir)).select("part", "rows", F.round("diversity", 4).alias("diversity"))


@query()
def ridge_refinement(spark, sf_dir):
    """The ridge with the least error over folds, narrowed down in rounds of five, and the error's slope by its logarithm there."""
    rows = vector_rows(spark, sf_dir).withColumn("y", F.array(F.col("label").cast("double")))
    return ridge.refine(rows, F.pmod(F.xxhash64("id"), F.lit(4)), 1.5, 1e-5, 10.0).select("round", "ridge", F.round("mse", 4).alias("mse"), F.round("slope", 4).alias("slope"))
