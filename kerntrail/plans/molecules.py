"""Queries on orders as molecules: graphs, descriptors, energies, text formats, nested kernels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import canonical as C
from ..operators import graphs as G
from ..operators import orbitals as O
from ..sources import text as X
from .registry import blocks, query, r6
from .tables import ATOMS, atom_rows, bond_rows, load


def _both(spark, sf_dir):
    atoms = atom_rows(spark, sf_dir)
    return atoms.select("graph", "atom", "z"), bond_rows(atoms)


@query(f"WITH {ATOMS} SELECT graph, z, count(*) AS n FROM m GROUP BY graph, z")
def stoichiometry(spark, sf_dir):
    return G.stoichiometry(_both(spark, sf_dir)[0])


@query(f"""WITH {ATOMS} SELECT graph FROM m GROUP BY graph HAVING count(*) BETWEEN 2 AND 5 AND bool_and(z IN (6, 7, 8)) AND NOT EXISTS (
  SELECT 1 FROM b JOIN m x ON b.graph = x.graph AND b.a = x.atom JOIN m y ON b.graph = y.graph AND b.b = y.atom WHERE b.graph = m.graph AND x.z = 8 AND y.z = 8)""")
def constraint_filter(spark, sf_dir):
    forbidden = spark.createDataFrame([(8, 8)], "z1 int, z2 int")
    return G.admissible(*_both(spark, sf_dir), forbidden, (2, 5), [6, 7, 8])


@query(f"""WITH {ATOMS}, e AS (SELECT graph, sum(CASE z WHEN 6 THEN -37.8 WHEN 7 THEN -54.6 ELSE -75.1 END) AS apart, sum(CASE z WHEN 6 THEN 4 WHEN 7 THEN 3 ELSE 2 END) AS bonds FROM m GROUP BY graph)
SELECT graph, floor((o_totalprice - apart) * 1e4 + 0.5) / 1e4 AS atomisation, floor((o_totalprice - apart) / bonds * 1e4 + 0.5) / 1e4 AS normalised FROM e JOIN orders ON graph = o_orderkey""")
def atomisation_energy(spark, sf_dir):
    totals = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("graph"), F.col("o_totalprice").alias("energy"))
    found = G.energies(_both(spark, sf_dir)[0], {6: -37.8, 7: -54.6, 8: -75.1}, {6: 4, 7: 3, 8: 2}, totals)
    return found.select("graph", *[(F.floor(F.col(c) * 1e4 + 0.5) / 1e4).alias(c) for c in ("atomisation", "normalised")])


@query(f"""WITH {ATOMS}, d AS (SELECT graph, a AS atom, "order" FROM b UNION ALL SELECT graph, b, "order" FROM b)
SELECT m.graph, m.atom, m.z, count(d.atom) AS neighbours, CAST(coalesce(sum("order"), 0) AS BIGINT) AS valence FROM m LEFT JOIN d USING (graph, atom) GROUP BY m.graph, m.atom, m.z""")
def coordination(spark, sf_dir):
    return G.degrees(*_both(spark, sf_dir))


@query(f"WITH {ATOMS} SELECT x.graph, x.atom AS a, y.atom AS b, CAST(abs(x.atom - y.atom) AS DOUBLE) AS d FROM m x JOIN m y USING (graph)")
def bond_hops(spark, sf_dir):
    return G.distances(*_both(spark, sf_dir)).select("graph", "a", "b", "d")


@query(f"""WITH {ATOMS}, l AS (SELECT graph, atom, z, sum(CASE z WHEN 6 THEN 0.76 WHEN 7 THEN 0.71 ELSE 0.66 END) OVER w AS s, CASE z WHEN 6 THEN 0.76 WHEN 7 THEN 0.71 ELSE 0.66 END AS r FROM m WINDOW w AS (PARTITION BY graph ORDER BY atom))
SELECT x.graph, x.atom AS a, y.atom AS b, round(CASE WHEN x.atom = y.atom THEN 0 WHEN x.atom < y.atom THEN 2 * (y.s - x.s) - y.r + x.r ELSE 2 * (x.s - y.s) - x.r + y.r END, 6) + 0.0 AS d FROM l x JOIN l y USING (graph)""")
def bond_lengths(spark, sf_dir):
    return G.distances(*_both(spark, sf_dir), radii={6: 0.76, 7: 0.71, 8: 0.66}).select("graph", "a", "b", r6("d").alias("d"))


@query(f"""WITH {ATOMS} SELECT x.graph, x.atom AS a, y.atom AS b,
  round(CASE WHEN x.atom = y.atom THEN 0.5 * pow(x.z, 2.4) ELSE x.z * y.z / abs(x.atom - y.atom) END, 6) AS v FROM m x JOIN m y USING (graph)""")
def graph_coulomb(spark, sf_dir):
    atoms, bonds = _both(spark, sf_dir)
    return G.coulomb(G.distances(atoms, bonds)).withColumn("v", r6("v"))


@query(f"""WITH {ATOMS}, p AS (SELECT x.graph, x.atom AS a, y.atom AS b, x.z AS za, y.z AS zb, list_distance(x.place, y.place) AS d FROM m x JOIN m y USING (graph))
SELECT graph, a, b, round(CASE WHEN a = b THEN 0.5 * pow(za, 2.4) ELSE za * zb / (d + 1) END, 6) AS v FROM p""")
def coulomb_matrix(spark, sf_dir):
    """Coulomb matrices of the atoms' places; distances are taken one longer, since places may coincide."""
    at = atom_rows(spark, sf_dir).select("graph", "atom", "z", "at")
    pairs = at.toDF("graph", "a", "za", "xa").join(at.toDF("graph", "b", "zb", "xb"), "graph")
    paths = pairs.select("graph", "a", "b", (F.sqrt(V.sqdist(F.col("xa"), F.col("xb"))) + 1).alias("d"), "za", "zb")
    return G.coulomb(paths).withColumn("v", r6("v"))


@query(f"""WITH {ATOMS}, c AS (SELECT x.graph, x.atom AS a, y.atom AS b, CASE WHEN x.atom = y.atom THEN 0.5 * pow(x.z, 2.4) ELSE x.z * y.z / abs(x.atom - y.atom) END AS v FROM m x JOIN m y USING (graph))
SELECT graph, 210 AS n, round(sum(CASE WHEN a = b THEN v END), 5) AS trace, round(sum(CASE WHEN a <= b THEN v END), 5) AS upper FROM c GROUP BY graph""")
def graph_descriptor(spark, sf_dir):
    """Descriptors as vectors; what the order of rows can't change is compared: length, diagonal, sum of the upper triangle."""
    atoms, bonds = _both(spark, sf_dir)
    size = max(20, atoms.groupBy("graph").count().agg(F.max("count")).first()[0] or 0)  # no graph loses atoms
    x = G.descriptor(G.coulomb(G.distances(atoms, bonds)), size)
    diagonal = V.total(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.get("x", (k * size - k * (k - 1) / 2).cast("int"))))
    return x.select("graph", F.size("x").alias("n"), F.round(diagonal, 5).alias("trace"), F.round(V.total(F.col("x")), 5).alias("upper"))


@query(f"""WITH {ATOMS}, k AS (SELECT graph, string_agg(CAST(z AS VARCHAR), '-' ORDER BY atom) AS f, string_agg(CAST(z AS VARCHAR), '-' ORDER BY atom DESC) AS r FROM m GROUP BY graph),
g AS (SELECT graph, least(f, r) AS k FROM k) SELECT graph, min(graph) OVER (PARTITION BY k) AS first_equal FROM g""")
def graph_keys(spark, sf_dir):
    """The first graph with the same key: numbering from either end gives one key."""
    keys = C.graph_keys(*_both(spark, sf_dir))
    first = keys.groupBy("key").agg(F.min("graph").alias("first_equal"))
    return keys.join(first, "key").select("graph", "first_equal")


@query(f"WITH {ATOMS} SELECT graph, atom, min(atom) OVER (PARTITION BY graph, CAST(floor((atom - 1) / 3) AS INTEGER)) AS component FROM m")
def graph_components(spark, sf_dir):
    """Components of the chains without every third bond."""
    atoms, bonds = _both(spark, sf_dir)
    return G.components(atoms, bonds.filter("a % 3 <> 0")).select("graph", "atom", "component")


@query(f"""WITH {ATOMS} SELECT graph, count(*) AS natoms, round(sum(place[1]), 6) AS x, round(sum(place[2]), 6) AS y, round(sum(place[3]), 6) AS z,
  string_agg(CASE z WHEN 6 THEN 'C' WHEN 7 THEN 'N' ELSE 'O' END, '' ORDER BY atom) AS symbols FROM m GROUP BY graph""")
def xyz_round_trip(spark, sf_dir):
    """Molecules as xyz texts, parsed again."""
    symbol = V.lookup({6: "C", 7: "N", 8: "O"}, F.col("z"))
    atom = F.struct("atom", symbol.alias("symbol"), F.col("at")[0].alias("x"), F.col("at")[1].alias("y"), F.col("at")[2].alias("z"))
    molecules = atom_rows(spark, sf_dir).groupBy("graph").agg(F.array_sort(F.collect_list(atom)).alias("atoms"))
    parsed = molecules.select("graph", X.parse_xyz(X.xyz_text(F.col("atoms"), F.concat(F.lit("id="), F.col("graph").cast("string")))).alias("m"))
    total = lambda c: r6(V.total(F.transform("m.atoms", lambda a: a[c])))
    own = X.key_values(F.col("m.comment"))["id"].cast("long")
    return parsed.select(own.alias("graph"), F.col("m.natoms").cast("long").alias("natoms"), total("x").alias("x"), total("y").alias("y"), total("z").alias("z"), F.array_join(F.transform("m.atoms", lambda a: a["symbol"]), "").alias("symbols"))


@query(f"""WITH {ATOMS} SELECT graph, string_agg(CAST(z AS VARCHAR) || CASE WHEN atom < (SELECT max(atom) FROM m q WHERE q.graph = m.graph) THEN '@' || CAST(atom AS VARCHAR) ELSE '' END, ':' ORDER BY atom) AS key,
  count(*) AS n_atoms, count(*) - 1 AS n_bonds FROM m GROUP BY graph""")
def graph_strings(spark, sf_dir):
    """Graph strings of the chains (atoms counted from 0), parsed again for their numbers of atoms and bonds."""
    chain = atom_rows(spark, sf_dir).groupBy("graph").agg(F.array_sort(F.collect_list(F.struct("atom", "z"))).alias("c"))
    atoms = F.transform("c", lambda s: F.struct(s["z"].alias("z"), F.lit(0).alias("hydrogens")))
    bonds = F.transform(F.filter("c", lambda s: s["atom"] > 1), lambda s: F.struct((s["atom"] - 2).alias("a"), (s["atom"] - 1).alias("b")))
    keys = chain.select("graph", X.graph_text(atoms, bonds).alias("key"))
    g = X.parse_graph(F.col("key"))
    return keys.select("graph", "key", F.size(g["atoms"]).cast("long").alias("n_atoms"), F.size(g["bonds"]).cast("long").alias("n_bonds"))


def _parts(spark, sf_dir):
    """Customers' segments as molecules: nations are parts, customers of a nation are summed to components by balance."""
    c = load(spark, sf_dir, "customer").select("c_mktsegment", "c_nationkey", F.floor(F.col("c_acctbal") / 2500).alias("level"))
    comp = c.groupBy("c_mktsegment", "c_nationkey", "level").agg(F.count(F.lit(1)).cast("double").alias("rho"))
    part = comp.groupBy("c_mktsegment", "c_nationkey").agg(F.array_sort(F.collect_list(F.struct("level", "rho"))).alias("c"), F.sum("rho").alias("rho"))
    comps = F.transform("c", lambda s: F.struct(s["rho"].alias("rho"), F.array(s["level"].cast("double"), s["rho"] / 10).alias("v")))
    return part.select(F.col("c_mktsegment").alias("id"), F.col("c_nationkey").alias("part"), F.lit(1.0).alias("rho"), comps.alias("comps"))


@query("""WITH c AS (SELECT c_mktsegment AS id, c_nationkey AS part, CAST(floor(c_acctbal / 2500) AS DOUBLE) AS level, CAST(count(*) AS DOUBLE) AS rho FROM customer GROUP BY 1, 2, 3),
s AS (SELECT a.id, a.part, sqrt(sum(a.rho * b.rho * exp(-(pow(a.level - b.level, 2) + pow(a.rho / 10 - b.rho / 10, 2)) / 4))) AS own FROM c a JOIN c b USING (id, part) GROUP BY 1, 2),
n AS (SELECT c.id, c.part, level, rho, rho / own AS w FROM c JOIN s USING (id, part))
SELECT a.id AS i, b.id AS j, round(sum(a.w * b.w * exp(-(pow(a.level - b.level, 2) + pow(a.rho / 10 - b.rho / 10, 2)) / 4)), 4) AS k FROM n a JOIN n b ON a.id <= b.id GROUP BY 1, 2""")
def orbital_kernel(spark, sf_dir):
    parts = _parts(spark, sf_dir)
    return O.molecule_kernel(parts, 1.0, blocks(parts), normalise=True).select("i", "j", F.round("k", 4).alias("k"))


@query("""WITH c AS (SELECT c_mktsegment AS id, c_nationkey AS part, CAST(floor(c_acctbal / 2500) AS DOUBLE) AS level, CAST(count(*) AS DOUBLE) AS rho FROM customer GROUP BY 1, 2, 3),
p AS (SELECT a.id AS i, a.part AS p, b.id AS j, b.part AS q, a.rho * b.rho AS w, pow(a.level - b.level, 2) + pow(a.rho / 10 - b.rho / 10, 2) AS d FROM c a JOIN c b ON a.id <= b.id),
k AS (SELECT i, p, j, q, sum(w * exp(-d / 4)) AS k, sum(w * exp(-d / 4) * d / 2) AS dk FROM p GROUP BY ALL),
n AS (SELECT k.i, k.j, k.k / sqrt(x.k * y.k) AS c, k.dk / sqrt(x.k * y.k) - k.k / sqrt(x.k * y.k) / 2 * (x.dk / x.k + y.dk / y.k) AS dc
  FROM k JOIN k x ON x.i = k.i AND x.j = k.i AND x.p = k.p AND x.q = k.p JOIN k y ON y.i = k.j AND y.j = k.j AND y.p = k.q AND y.q = k.q)
SELECT i, j, round(sum(exp(-(1 - c) / 0.25)), 4) AS k, round(sum(exp(-(1 - c) / 0.25) * dc / 0.25), 4) AS dk, round(sum(exp(-(1 - c) / 0.25) * 2 * (1 - c) / 0.125), 4) AS dwidth FROM n GROUP BY 1, 2""")
def orbital_kernel_slopes(spark, sf_dir):
    """Gaussians of normalised part kernels, with their slopes by the width of the components, through the normalisation, and by their own."""
    parts = _parts(spark, sf_dir)
    found = O.molecule_kernel(parts, 1.0, blocks(parts), width=0.5, slope=True, normalise=True)
    return found.select("i", "j", *[(F.round(c, 4) + F.lit(0.0)).alias(c) for c in ("k", "dk", "dwidth")])
