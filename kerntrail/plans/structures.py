"""Queries on orders as molecules with hydrogens: valences, classes, moves, fragments, orbitals' matrices."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import vectors as V
from ..operators import canonical as C
from ..operators import graphs as G
from ..operators import molecules as M
from ..operators import orbitals as O
from ..operators import records as R
from ..operators import resonance as Z
from ..operators import rewriting as Y
from .molecules import _both, _parts
from .registry import blocks, query, r6
from .tables import ATOMS, atom_rows, bond_rows, load

ELEMENTS = [6, 7, 8]
#: The same atoms with sulphur, which has several valences, where a line's quantity is great.
SULPHUR = ATOMS.replace("CASE l_returnflag WHEN 'A' THEN 6 WHEN 'N' THEN 7 ELSE 8 END AS z", "CASE WHEN l_quantity > 40 THEN 16 WHEN l_returnflag = 'A' THEN 6 WHEN l_returnflag = 'N' THEN 7 ELSE 8 END AS z")
FILLED = """, ends AS (SELECT graph, a AS atom, "order" FROM b UNION ALL SELECT graph, b, "order" FROM b),
used AS (SELECT m.graph, m.atom, m.z, count(ends.atom) AS neighbours, CAST(coalesce(sum("order"), 0) AS BIGINT) AS used FROM m LEFT JOIN ends USING (graph, atom) GROUP BY m.graph, m.atom, m.z),
v AS (SELECT *, list_min(list_filter(CASE z WHEN 6 THEN [4] WHEN 7 THEN [3] WHEN 8 THEN [2] ELSE [2, 4, 6] END, lambda k: k >= used)) AS valence FROM used),
h AS (SELECT *, valence - used AS hydrogens FROM v)"""
KEYS = """, bonded AS (SELECT m.graph, m.atom, m.z, coalesce(n."order", 0) AS ahead, coalesce(p."order", 0) AS back
  FROM m LEFT JOIN b n ON m.graph = n.graph AND m.atom = n.a LEFT JOIN b p ON m.graph = p.graph AND m.atom = p.b),
texts AS (SELECT graph, count(*) AS n, bool_and(z = 6) AS pure, string_agg(z || ':' || ahead, ' ' ORDER BY atom) AS f, string_agg(z || ':' || back, ' ' ORDER BY atom DESC) AS r,
  string_agg('6:' || ahead, ' ' ORDER BY atom) AS cf, string_agg('6:' || back, ' ' ORDER BY atom DESC) AS cr FROM bonded GROUP BY graph),
keys AS (SELECT graph, n, pure, f = r AS mirrored, least(f, r) AS key, least(cf, cr) AS bare FROM texts)"""


def _filled(spark, sf_dir):
    atoms, bonds = _both(spark, sf_dir)
    return M.filled(atoms, bonds), bonds


def _sulphur(spark, sf_dir):
    atoms = atom_rows(spark, sf_dir).withColumn("z", F.when(F.col("l_quantity") > 40, 16).otherwise(F.col("z")))
    bonds = bond_rows(atoms)
    return M.filled(atoms.select("graph", "atom", "z"), bonds), bonds


@query(f"WITH {ATOMS}{FILLED} SELECT graph, atom, z, neighbours, used, coalesce(valence, -1) AS valence, coalesce(hydrogens, -1) AS hydrogens FROM h")
def hydrogen_fill(spark, sf_dir):
    """Atoms with their valences and hydrogens, -1 where the bonds allow none."""
    return _filled(spark, sf_dir)[0].select("graph", "atom", "z", "neighbours", "used", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("valence", "hydrogens")])


@query(f"""WITH {ATOMS}{FILLED}, c AS (SELECT graph, count(*) AS heavy, CAST(sum(coalesce(hydrogens, 0)) AS BIGINT) AS hydrogens FROM h GROUP BY graph)
SELECT graph, heavy + hydrogens AS atoms, heavy - 1 + hydrogens AS bonds, hydrogens, CASE WHEN hydrogens > 0 THEN heavy + hydrogens ELSE 0 END AS last FROM c""")
def full_adjacency(spark, sf_dir):
    """Atoms and bonds with all hydrogens, counted; the last hydrogen has the last number."""
    atoms, bonds = M.with_hydrogens(*_filled(spark, sf_dir))
    light = F.col("z") == 1
    found = atoms.groupBy("graph").agg(F.count(F.lit(1)).alias("atoms"), F.count_if(light).alias("hydrogens"), F.max(F.when(light, F.col("atom")).otherwise(0)).alias("last"))
    return found.join(bonds.groupBy("graph").agg(F.count(F.lit(1)).alias("bonds")), "graph", "left").select("graph", "atoms", F.coalesce("bonds", F.lit(0)).alias("bonds"), "hydrogens", "last")


@query(f"WITH {ATOMS}{FILLED} SELECT graph FROM h GROUP BY graph HAVING NOT bool_or(z = 8 AND coalesce(hydrogens, 0) > 0)")
def unprotonated(spark, sf_dir):
    """Graphs without a hydrogen at any oxygen."""
    return M.unprotonated(_filled(spark, sf_dir)[0], [8])


@query(f"""WITH {ATOMS}{FILLED}, e AS (SELECT *, neighbours + coalesce(hydrogens, 0) AS coordination, coalesce(CASE z WHEN 6 THEN 0 WHEN 7 THEN 1 ELSE 2 END + 0 * valence, 0) AS pairs FROM h)
SELECT graph, atom, coordination, coordination + pairs AS effective, CASE coordination + pairs WHEN 4 THEN 'sp3' WHEN 3 THEN 'sp2' WHEN 2 THEN 'sp' END AS hybridisation FROM e""")
def hybridisation(spark, sf_dir):
    return M.coordination(_filled(spark, sf_dir)[0]).select("graph", "atom", "coordination", "effective", "hybridisation")


@query(f"""WITH {ATOMS}{FILLED} SELECT graph, count(*) AS heavy, CAST(sum(coalesce(hydrogens, 0)) AS BIGINT) AS hydrogens, CAST(sum(used) // 2 + sum(coalesce(hydrogens, 0)) AS BIGINT) AS covalent FROM h GROUP BY graph""")
def bond_totals(spark, sf_dir):
    return M.totals(_filled(spark, sf_dir)[0])


@query(f"""WITH {ATOMS}{FILLED}, s AS (SELECT graph, sum(CASE z WHEN 6 THEN -40.5 WHEN 7 THEN -56.5 ELSE -76.4 END) AS hydrides, sum(CASE z WHEN 6 THEN 4 WHEN 7 THEN 3 ELSE 2 END - coalesce(hydrogens, 0)) AS free FROM h GROUP BY graph)
SELECT graph, round(o_totalprice - hydrides - 1.17 * free / 2, 4) AS energy FROM s JOIN orders ON o_orderkey = graph""")
def hydrogenation_energy(spark, sf_dir):
    totals = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("graph"), F.col("o_totalprice").alias("energy"))
    return M.hydrogenation(_filled(spark, sf_dir)[0], totals, {6: -40.5, 7: -56.5, 8: -76.4}, -1.17).select("graph", F.round("energy", 4).alias("energy"))


@query(f"WITH {ATOMS}{KEYS} SELECT min(graph) AS graph, count(*) AS copies FROM keys GROUP BY key")
def unique_graphs(spark, sf_dir):
    return M.unique(*_both(spark, sf_dir))


@query(f"""WITH {ATOMS}{KEYS}, pure AS (SELECT key, min(graph) AS graph FROM keys WHERE pure GROUP BY key),
others AS (SELECT bare, min(graph) AS graph FROM keys WHERE NOT pure AND bare NOT IN (SELECT key FROM pure) GROUP BY bare)
SELECT graph, 0 AS tier FROM pure UNION ALL SELECT graph, 1 FROM others""")
def carbonised_dedup(spark, sf_dir):
    return M.carbonised_unique(*_both(spark, sf_dir))


@query(f"WITH {ATOMS} SELECT DISTINCT graph, TRUE AS same FROM m")
def shuffled_keys(spark, sf_dir):
    """Whether graphs keep their key when their atoms are renumbered."""
    atoms, bonds = _both(spark, sf_dir)
    keys, others = C.graph_keys(atoms, bonds), C.graph_keys(*M.shuffled(atoms, bonds, 3))
    return keys.join(others.withColumnRenamed("key", "other"), "graph").select("graph", (F.col("key") == F.col("other")).alias("same"))


@query(f"""WITH {ATOMS}{KEYS} SELECT m.graph, least(m.atom, CASE WHEN mirrored THEN n + 1 - m.atom ELSE m.atom END) AS class, count(*) AS members FROM m JOIN keys USING (graph) GROUP BY 1, 2""")
def atom_classes(spark, sf_dir):
    """Atoms that a renumbering maps to each other: of a chain that reads the same from its other end, mirror images."""
    return C.equivalence(*_both(spark, sf_dir)).select("graph", "class", "members")


@query(f"""WITH {ATOMS}{KEYS}, first AS (SELECT k.graph, k.n, mirrored, f, min(k.graph) OVER (PARTITION BY key) AS model FROM keys k JOIN texts t ON t.graph = k.graph),
p AS (SELECT x.graph, x.model, x.n, x.mirrored, x.f = y.f AS straight FROM first x JOIN texts y ON y.graph = x.model),
a AS (SELECT p.*, m.atom, CASE WHEN straight THEN m.atom ELSE n + 1 - m.atom END AS there FROM m JOIN p USING (graph))
SELECT graph, atom, model, least(there, CASE WHEN mirrored THEN n + 1 - there ELSE there END) AS class FROM a""")
def transferred_classes(spark, sf_dir):
    return M.transferred_classes(*_both(spark, sf_dir))


@query(f"""WITH {ATOMS}, c AS (SELECT graph, list(z ORDER BY atom) AS z, count(*) AS n FROM m GROUP BY graph HAVING count(*) >= 3),
o AS (SELECT *, list_transform(range(1, n + 1), lambda k: CASE WHEN k < n AND z[k] = 7 AND z[k + 1] = 7 THEN 2 ELSE 1 END) AS o FROM c),
r AS (SELECT graph, n, i + 1 AS atom, array_to_string(list_transform(range(0, n), lambda j: z[(i + j) % n + 1] || ':' || o[(i + j) % n + 1]), ' ') AS f,
  array_to_string(list_transform(range(0, n), lambda j: z[(i - j + n) % n + 1] || ':' || o[(i - j - 1 + 2 * n) % n + 1]), ' ') AS b FROM (SELECT *, unnest(range(0, n)) AS i FROM o)),
k AS (SELECT graph, min(least(f, b)) AS key FROM r GROUP BY graph)
SELECT r.graph, CAST(atom AS INTEGER) AS atom, CAST(min(atom) OVER (PARTITION BY r.graph, least(f, b)) AS INTEGER) AS orbit, min(r.graph) OVER (PARTITION BY key) AS first_equal FROM r JOIN k USING (graph)""")
def ring_classes(spark, sf_dir):
    """The chains of three atoms or more, closed to rings: atoms' symmetry classes, and the first ring that is the same but for numbering."""
    atoms, bonds = _both(spark, sf_dir)
    ends = atoms.groupBy("graph").agg(F.min("atom").alias("a"), F.max("atom").alias("b")).filter("b > 2")
    closed = bonds.unionByName(ends.withColumn("order", F.lit(1)))
    found = C.labelled(atoms.join(ends, "graph", "left_semi"), closed.join(ends, "graph", "left_semi"))
    first = found.filter("place = 0").groupBy("key").agg(F.min("graph").alias("first_equal"))
    return found.join(first, "key").select("graph", "atom", "orbit", "first_equal")


@query(f"WITH {ATOMS} SELECT graph, atom, 3 * ((atom - 1) // 3) + 1 AS fragment, (atom - 1) % 3 + 1 AS place FROM m")
def cut_fragments(spark, sf_dir):
    """Chains cut behind every third atom."""
    atoms, bonds = _both(spark, sf_dir)
    return M.fragments(atoms, bonds, bonds.filter("a % 3 = 0").select("graph", "a", "b"))


@query(f"""WITH {ATOMS}{KEYS}, c AS (SELECT m.graph, m.atom, least(m.atom, CASE WHEN mirrored THEN n + 1 - m.atom ELSE m.atom END) AS class FROM m JOIN keys USING (graph))
SELECT x.graph, x.class AS class_a, y.class AS class_b, CAST(abs(x.atom - y.atom) AS DOUBLE) AS d, count(*) AS pairs FROM c x JOIN c y ON x.graph = y.graph AND x.atom <> y.atom GROUP BY 1, 2, 3, 4""")
def pair_classes(spark, sf_dir):
    return M.pair_classes(*_both(spark, sf_dir))


@query(f"""WITH {ATOMS}{KEYS}, p AS (SELECT x.graph, x.atom AS a, y.atom AS b, CASE WHEN mirrored THEN n + 1 - x.atom ELSE x.atom END AS c, CASE WHEN mirrored THEN n + 1 - y.atom ELSE y.atom END AS d
  FROM m x JOIN m y USING (graph) JOIN keys ON keys.graph = x.graph)
SELECT graph, a, b, CAST(least(a, c) AS INTEGER) AS orbit_a, CAST(CASE WHEN a < c THEN b WHEN a > c THEN d ELSE least(b, d) END AS INTEGER) AS orbit_b FROM p""")
def pair_orbits(spark, sf_dir):
    """Ordered pairs of atoms that a symmetry maps to each other: of a chain that reads the same from its other end, mirror images."""
    return C.pair_orbits(*_both(spark, sf_dir))


@query(f"""WITH {ATOMS}{FILLED}, e AS (SELECT graph, atom, CASE WHEN neighbours + coalesce(hydrogens, 0) + coalesce(CASE z WHEN 6 THEN 0 WHEN 7 THEN 1 ELSE 2 END + 0 * valence, 0) > 3 THEN 1 ELSE 0 END AS bad FROM h),
s AS (SELECT *, sum(bad) OVER (PARTITION BY graph ORDER BY atom) AS upto FROM e)
SELECT x.graph, x.atom AS a, y.atom AS b, CAST(y.atom - x.atom AS DOUBLE) AS d FROM s x JOIN s y ON x.graph = y.graph AND x.atom <= y.atom AND (x.atom = y.atom OR y.upto - x.upto + x.bad = 0)""")
def masked_distances(spark, sf_dir):
    """Paths along atoms with an effective coordination of three at most."""
    atoms, bonds = _filled(spark, sf_dir)
    return M.masked_distances(M.coordination(atoms), bonds, 3).filter("a <= b").select("graph", "a", "b", "d")


@query(f"""WITH {ATOMS}{FILLED}, p AS (SELECT x.graph, x.atom, x.hydrogens, list_slice(list_sort(list({{'d': abs(x.atom - y.atom) + 1, 'b': y.atom}})), 1, 4) AS s
  FROM h x JOIN h y ON x.graph = y.graph WHERE x.hydrogens > 0 GROUP BY 1, 2, 3)
SELECT graph, atom, hydrogens, array_to_string(list_transform(s, lambda t: t.b), ',') AS near, CAST(list_sum(list_transform(s, lambda t: t.d)) AS DOUBLE) AS reach FROM p""")
def hydrogen_surroundings(spark, sf_dir):
    """The four heavy atoms nearest to each atom's hydrogens."""
    found = M.hydrogen_surroundings(*_filled(spark, sf_dir), 4)
    return found.select("graph", "atom", "hydrogens", F.array_join(F.col("near").cast("array<string>"), ",").alias("near"), V.total(F.col("d")).alias("reach"))


@query(f"""WITH {ATOMS}, d AS (SELECT x.graph, x.atom AS a, y.atom AS b, abs(x.atom - y.atom) AS d FROM m x JOIN m y USING (graph)), n AS (SELECT graph, count(*) AS n FROM m GROUP BY graph)
SELECT graph, n, CAST(sum(d) FILTER (WHERE a < b) AS DOUBLE) AS hops, CAST((SELECT sum("order") FROM b WHERE b.graph = d.graph) AS DOUBLE) AS orders FROM d JOIN n USING (graph) WHERE n > 1 GROUP BY graph, n""")
def hop_descriptor(spark, sf_dir):
    """Descriptors from distances in bonds and from bond orders: sums, which no order of atoms changes."""
    atoms, bonds = _both(spark, sf_dir)
    size = max(20, atoms.groupBy("graph").count().agg(F.max("count")).first()[0] or 0)
    return G.descriptor_totals(atoms, bonds, size).filter("n > 1")


@query(f"""WITH {SULPHUR}{FILLED}, s AS (SELECT * REPLACE (coalesce(hydrogens, 0) AS hydrogens) FROM h), o AS (SELECT unnest([6, 7, 8]) AS e, unnest([4, 3, 2]) AS most),
near AS (SELECT graph, a AS atom, b, "order" FROM b UNION ALL SELECT graph, b, a, "order" FROM b),
k AS (
  SELECT graph, 'add' AS kind FROM s, o WHERE hydrogens > 0
  UNION ALL SELECT graph, 'remove' FROM s WHERE neighbours = 1
  UNION ALL SELECT graph, 'replace' FROM s, o WHERE e <> z AND most >= used
  UNION ALL SELECT graph, 'valence' FROM s WHERE z = 16 AND valence < 6
  UNION ALL SELECT graph, 'valence' FROM s WHERE z = 16 AND valence > 2 AND hydrogens >= 2
  UNION ALL SELECT graph, 'valence_add' FROM s, o WHERE z = 16 AND valence < 6 AND most >= 2
  UNION ALL SELECT x.graph, 'bond' FROM s x JOIN s y ON x.graph = y.graph AND x.atom < y.atom AND x.hydrogens > 0 AND y.hydrogens > 0
    LEFT JOIN b ON b.graph = x.graph AND b.a = x.atom AND b.b = y.atom WHERE b."order" IS NULL OR b."order" < 3
  UNION ALL SELECT graph, 'bond' FROM b WHERE "order" > 1
  UNION ALL SELECT s.graph, 'valence_remove' FROM s JOIN near USING (graph, atom) JOIN s y ON y.graph = s.graph AND y.atom = near.b WHERE s.z = 16 AND s.valence > 2 AND y.neighbours = 1 AND near."order" = 2
  UNION ALL SELECT s.graph, 'valence_bond' FROM s JOIN near USING (graph, atom) JOIN s y ON y.graph = s.graph AND y.atom = near.b WHERE s.z = 16 AND s.valence < 6 AND y.hydrogens >= 2 AND near."order" + 2 <= 3)
SELECT graph, kind, count(*) AS moves FROM k GROUP BY graph, kind""")
def move_kinds(spark, sf_dir):
    """How many changes of each kind every molecule allows."""
    return M.moves(*_sulphur(spark, sf_dir), ELEMENTS).groupBy("graph", "kind").agg(F.count(F.lit(1)).alias("moves"))


@query(f"""WITH {SULPHUR}{FILLED}, s AS (SELECT * REPLACE (coalesce(hydrogens, 0) AS hydrogens) FROM h), o AS (SELECT unnest([6, 7, 8]) AS e, unnest([4, 3, 2]) AS most),
near AS (SELECT graph, a AS atom, b, "order" FROM b UNION ALL SELECT graph, b, a, "order" FROM b),
k AS (
  SELECT graph, 'add' AS kind, 1 AS da, most - 2 AS dh FROM s, o WHERE hydrogens > 0
  UNION ALL SELECT s.graph, 'remove', -1, -s.hydrogens + CASE WHEN y.valence IS NULL THEN 3 - y.used + near."order" ELSE near."order" END FROM s JOIN near USING (graph, atom) JOIN s y ON y.graph = s.graph AND y.atom = near.b WHERE s.neighbours = 1
  UNION ALL SELECT graph, 'replace', 0, most - used - hydrogens FROM s, o WHERE e <> z AND most >= used
  UNION ALL SELECT graph, 'valence', 0, 2 FROM s WHERE z = 16 AND valence < 6
  UNION ALL SELECT graph, 'valence', 0, -2 FROM s WHERE z = 16 AND valence > 2 AND hydrogens >= 2
  UNION ALL SELECT graph, 'valence_add', 1, most - 2 FROM s, o WHERE z = 16 AND valence < 6 AND most >= 2
  UNION ALL SELECT x.graph, 'bond', 0, -2 FROM s x JOIN s y ON x.graph = y.graph AND x.atom < y.atom AND x.hydrogens > 0 AND y.hydrogens > 0
    LEFT JOIN b ON b.graph = x.graph AND b.a = x.atom AND b.b = y.atom WHERE b."order" IS NULL OR b."order" < 3
  UNION ALL SELECT b.graph, 'bond', 0, (x.valence IS NOT NULL)::INT + (y.valence IS NOT NULL)::INT FROM b JOIN s x ON x.graph = b.graph AND x.atom = b.a JOIN s y ON y.graph = b.graph AND y.atom = b.b WHERE "order" > 1
  UNION ALL SELECT s.graph, 'valence_remove', -1, -y.hydrogens FROM s JOIN near USING (graph, atom) JOIN s y ON y.graph = s.graph AND y.atom = near.b WHERE s.z = 16 AND s.valence > 2 AND y.neighbours = 1 AND near."order" = 2
  UNION ALL SELECT s.graph, 'valence_bond', 0, -2 FROM s JOIN near USING (graph, atom) JOIN s y ON y.graph = s.graph AND y.atom = near.b WHERE s.z = 16 AND s.valence < 6 AND y.hydrogens >= 2 AND near."order" + 2 <= 3),
t AS (SELECT graph, count(*) AS n, sum(hydrogens) AS hydrogens FROM s GROUP BY graph)
SELECT graph, kind, CAST(sum(n + da) AS BIGINT) AS atoms, CAST(sum(hydrogens + dh) AS BIGINT) AS hydrogens FROM k JOIN t USING (graph) GROUP BY graph, kind""")
def applied_moves(spark, sf_dir):
    """All graphs that one move makes of every molecule, by kind of move: their atoms and hydrogens."""
    atoms, bonds = _sulphur(spark, sf_dir)
    moves = Y.numbered(M.moves(atoms, bonds, ELEMENTS))
    made, _ = Y.applied(atoms, bonds, moves)
    return made.groupBy(F.col("source").alias("graph"), "kind").agg(F.count(F.lit(1)).alias("atoms"), F.sum(F.coalesce("hydrogens", F.lit(0)).cast("long")).alias("hydrogens"))


@query(f"""WITH {ATOMS}, n AS (SELECT graph, CAST(count(*) AS INTEGER) AS n FROM m GROUP BY graph), r AS (SELECT graph, n, atom AS c, greatest(atom - 1, 1) AS low, least(atom + 1, n) AS high FROM m JOIN n USING (graph)),
f AS (SELECT graph, n, low, high, high - low + 1 AS size FROM r WHERE high - low + 1 < n GROUP BY ALL),
cut AS (SELECT f.graph, low, high, size, n, list_sort(list("order")) AS orders FROM f JOIN b ON b.graph = f.graph AND (b.b = low OR b.a = high) GROUP BY ALL),
o AS (SELECT o_orderkey AS l, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders)
SELECT o.l AS "left", o.r AS "right", CAST(sum(CASE WHEN len(x.orders) = 2 AND x.orders[1] = x.orders[2] THEN 2 ELSE 1 END) AS BIGINT) AS children,
  CAST(sum((x.size + y.n - y.size) * CASE WHEN len(x.orders) = 2 AND x.orders[1] = x.orders[2] THEN 2 ELSE 1 END) AS BIGINT) AS atoms,
  CAST(sum((x.size - 1 + len(x.orders) + y.n - 1 - (y.size - 1) - len(y.orders)) * CASE WHEN len(x.orders) = 2 AND x.orders[1] = x.orders[2] THEN 2 ELSE 1 END) AS BIGINT) AS bonds
FROM o JOIN cut x ON x.graph = o.l JOIN cut y ON y.graph = o.r AND x.orders = y.orders WHERE o.r IS NOT NULL GROUP BY 1, 2""")
def ball_crossings(spark, sf_dir):
    """Each customer's consecutive orders as molecules, balls of one bond exchanged in all ways: children, their atoms and bonds."""
    following = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    couples = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("left"), following.alias("right")).filter("right IS NOT NULL")
    children, atoms, bonds = Y.crossed(couples, *_both(spark, sf_dir), 1)
    sizes = atoms.groupBy("graph").agg(F.count(F.lit(1)).alias("atoms")).join(bonds.groupBy("graph").agg(F.count(F.lit(1)).alias("bonds")), "graph", "left")
    found = children.join(sizes, "graph").groupBy("left", "right")
    return found.agg(F.count(F.lit(1)).alias("children"), F.sum("atoms").alias("atoms"), F.sum(F.coalesce("bonds", F.lit(0))).alias("bonds"))


@query(f"""WITH {ATOMS}, f AS (SELECT graph AS id, list_sort(list("order")) AS orders FROM b GROUP BY graph),
o AS (SELECT o_orderkey AS l, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders)
SELECT o.l AS "left", o.r AS "right", CAST(factorial(CAST(len(list_filter(x.orders, lambda k: k = 1)) AS INTEGER)) * factorial(CAST(len(list_filter(x.orders, lambda k: k = 2)) AS INTEGER)) AS BIGINT) AS ways
FROM o JOIN f x ON x.id = o.l JOIN f y ON y.id = o.r WHERE x.orders = y.orders""")
def matching_fragments(spark, sf_dir):
    """Each customer's consecutive orders whose bonds have equal orders."""
    following = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    couples = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("left"), following.alias("right")).filter("right IS NOT NULL")
    fragments = bond_rows(atom_rows(spark, sf_dir)).groupBy(F.col("graph").alias("id")).agg(F.collect_list("order").alias("orders"))
    return M.matching_fragments(couples, fragments)


@query(f"""WITH {ATOMS}, n AS (SELECT graph, list(z ORDER BY atom) AS c, count(*) AS n, min(z) AS low, max(z) AS high FROM m GROUP BY graph)
SELECT n.graph, CAST(list_sum(c) AS BIGINT) AS charges, CAST(-list_sum(list_transform(c, lambda z: z - 6)) AS BIGINT) AS slide, CASE WHEN n <= 2 THEN 0 WHEN n <= 5 THEN 1 ELSE -1 END AS heavy,
  CASE WHEN n = 2 THEN CASE WHEN low <> high THEN 2 WHEN low = 8 THEN 1 ELSE 0 END + (SELECT max("order") FROM b WHERE b.graph = n.graph) - 1 ELSE -1 END AS barrier FROM n""")
def toy_objectives(spark, sf_dir):
    """Small objectives of molecules: sum of charges, places of elements, an interval of sizes, and a barrier for two atoms."""
    atoms, bonds = _both(spark, sf_dir)
    chain = atoms.groupBy("graph").agg(F.transform(F.array_sort(F.collect_list(F.struct("atom", "z"))), lambda s: s["z"]).alias("c"))
    c, n = F.col("c"), F.size("c")
    first = bonds.groupBy("graph").agg(F.max("order").alias("order"))
    barrier = F.when(n == 2, S.diatomic_barrier(F.get(c, F.lit(0)), F.get(c, F.lit(1)), F.col("order"), 8))
    return chain.join(first, "graph", "left").select(
        "graph", F.aggregate(c, F.lit(0), lambda s, z: s + z).cast("long").alias("charges"), S.order_slide(c, ELEMENTS).cast("long").alias("slide"), F.coalesce(S.in_interval(n, [(0, 2), (3, 5)]), F.lit(-1)).alias("heavy"), F.coalesce(barrier, F.lit(-1)).alias("barrier"),
    )


@query(f"""WITH {ATOMS}, n AS (SELECT *, CASE z WHEN 6 THEN 'C' WHEN 7 THEN 'N' ELSE 'O' END AS s FROM m) SELECT graph, string_agg(DISTINCT s, ',' ORDER BY s) AS elements FROM n GROUP BY graph""")
def distinct_elements(spark, sf_dir):
    symbol = V.lookup({z: s for s, z in V.CHARGE.items()}, F.col("z"))
    return _both(spark, sf_dir)[0].groupBy("graph").agg(F.array_join(F.array_sort(F.collect_set(symbol)), ",").alias("elements"))


@query(f"WITH {SULPHUR}{FILLED} SELECT graph, atom, CASE WHEN z = 16 AND valence < 6 THEN valence + 2 ELSE 0 END AS up, CASE WHEN z = 16 AND valence > 2 THEN valence - 2 ELSE 0 END AS down, z = 16 AS polyvalent FROM h")
def next_valences(spark, sf_dir):
    z, v = F.col("z"), F.col("valence")
    return _sulphur(spark, sf_dir)[0].select("graph", "atom", F.coalesce(S.next_valence(z, v), F.lit(0)).alias("up"), F.coalesce(S.next_valence(z, v, up=False), F.lit(0)).alias("down"), S.polyvalent(z).alias("polyvalent"))


@query(f"WITH {ATOMS} SELECT graph, 2 * count(*) AS rows, round(2 * sum(place[1]), 6) AS x, round(2 * sum(place[2]) + 2 * count(*), 6) AS y FROM m GROUP BY graph")
def stacked_coordinates(spark, sf_dir):
    """Places of heavy atoms with those of one hydrogen above each, as one matrix."""
    rows = atom_rows(spark, sf_dir).groupBy("graph").agg(F.transform(F.array_sort(F.collect_list(F.struct("atom", "at"))), lambda s: s["at"]).alias("heavy"))
    light = F.transform("heavy", lambda p: F.array(F.get(p, F.lit(0)), F.get(p, F.lit(1)) + 2, F.get(p, F.lit(2))))
    stacked = rows.select("graph", F.concat("heavy", light).alias("x"))
    part = lambda k: r6(V.total(F.transform("x", lambda p: F.get(p, F.lit(k)))))
    return stacked.select("graph", F.size("x").cast("long").alias("rows"), part(0).alias("x"), part(1).alias("y"))


CONJUGATED = """, r AS (SELECT graph, atom, z, count(*) OVER (PARTITION BY graph) AS n, max(CASE WHEN z = 8 THEN atom END) OVER (PARTITION BY graph) AS final,
  max(CASE WHEN z = 8 THEN atom END) OVER (PARTITION BY graph ORDER BY atom ROWS UNBOUNDED PRECEDING) AS before FROM m),
d AS (SELECT graph, atom, z, n, final IS NULL AS whole, atom - coalesce(before, final - n) AS d FROM r WHERE n >= 3),
x AS (SELECT d.*, nxt.z AS z2, nxt.d AS d2 FROM d JOIN d nxt ON nxt.graph = d.graph AND nxt.atom = d.atom % d.n + 1),
valid AS (SELECT graph, CASE WHEN bool_or(whole) THEN bool_and(n % 2 = 0) ELSE bool_and(z2 <> 8 OR d % 2 = 0) END AS valid FROM x GROUP BY graph)"""


def _conjugated(spark, sf_dir):
    """The chains of three atoms or more, closed to rings: carbons have one hydrogen, so they and nitrogens share one valence more with a neighbour."""
    atoms, bonds = _both(spark, sf_dir)
    ends = atoms.groupBy("graph").agg(F.min("atom").alias("a"), F.max("atom").alias("b")).filter("b > 2")
    ring = bonds.select("graph", "a", "b").unionByName(ends).join(ends.select("graph"), "graph", "left_semi")
    return atoms.join(ends, "graph", "left_semi").withColumn("hydrogens", F.when(F.col("z") == 6, 1).otherwise(0)), ring


@query(f"""WITH {ATOMS}{CONJUGATED}
SELECT x.graph, CAST(CASE WHEN atom < n THEN atom ELSE 1 END AS INTEGER) AS a, CAST(CASE WHEN atom < n THEN atom + 1 ELSE n END AS INTEGER) AS b,
  CASE WHEN NOT valid THEN NULL WHEN whole THEN 1.5::DOUBLE WHEN z <> 8 AND z2 <> 8 AND d % 2 = 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS mean,
  CAST(CASE WHEN NOT valid THEN 0 WHEN whole THEN 2 ELSE 1 END AS BIGINT) AS structures FROM x JOIN valid USING (graph)""")
def ring_bond_orders(spark, sf_dir):
    """Mean bond orders of rings and how many resonance structures they have: two without oxygens, else one, or none."""
    found = Z.bond_orders(*_conjugated(spark, sf_dir))
    return found.select("graph", "a", "b", "mean", F.col("structures").cast("long").alias("structures"))


@query(f"""WITH {ATOMS}{CONJUGATED}, s AS (SELECT x.graph, whole, n, count(*) FILTER (WHERE z <> 8 AND z2 <> 8) AS inner_bonds, count(*) FILTER (WHERE z <> 8 AND z2 <> 8 AND d % 2 = 1) AS doubles
  FROM x JOIN valid USING (graph) WHERE valid GROUP BY 1, 2, 3)
SELECT graph, CAST(CASE WHEN whole THEN 2 * n ELSE inner_bonds END AS BIGINT) AS bonds, CAST(CASE WHEN whole THEN 3 * n ELSE inner_bonds + doubles END AS BIGINT) AS orders FROM s WHERE inner_bonds > 0""")
def resonance_structures(spark, sf_dir):
    """All structures of the rings' conjugated parts, summed: bonds and orders."""
    found = Z.resonance_structures(*_conjugated(spark, sf_dir))
    return found.groupBy("graph").agg(F.count(F.lit(1)).alias("bonds"), F.sum("order").alias("orders"))


# orbitals: a line is an atomic orbital of one of two orbitals of its order

LINES = """o AS (SELECT l_orderkey AS id, l_suppkey % 2 AS orb, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS ao, l_suppkey % 3 AS atom, l_partkey % 3 AS l, l_discount + 0.01::DOUBLE AS c FROM lineitem)"""
FOCK = LINES + """, f AS (SELECT x.id, x.ao AS a, y.ao AS b, sum(x.c * (x.orb + 1) * y.c) AS v FROM o x JOIN o y ON x.id = y.id AND x.orb = y.orb GROUP BY 1, 2, 3)"""


def _lines(spark, sf_dir):
    ao = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    return load(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("id"), (F.col("l_suppkey") % 2).alias("orb"), ao.alias("ao"), (F.col("l_suppkey") % 3).alias("atom"), (F.col("l_partkey") % 3).alias("l"), (F.col("l_discount") + 0.01).alias("c"),
    )


@query(f"WITH {LINES} SELECT x.id, x.ao AS a, y.ao AS b, round(sum(x.c * cos(0.5 * (x.orb + 1)) * y.c), 6) AS v FROM o x JOIN o y ON x.id = y.id AND x.orb = y.orb GROUP BY 1, 2, 3")
def propagator_matrix(spark, sf_dir):
    """Coupling matrices of orbitals whose energies are their numbers, at a time of one half."""
    return R.orbital_matrix(_lines(spark, sf_dir), F.cos(0.5 * (F.col("orb") + 1))).select("id", "a", "b", r6("v").alias("v"))


@query(f"WITH {FOCK} SELECT x.id, x.orb, x.atom = y.atom AS same, x.l AS l1, y.l AS l2, round(sum(f.v * x.c * y.c), 9) AS v FROM o x JOIN o y ON x.id = y.id AND x.orb = y.orb JOIN f ON f.id = x.id AND f.a = x.ao AND f.b = y.ao GROUP BY 1, 2, 3, 4, 5")
def orbital_couplings(spark, sf_dir):
    rows = _lines(spark, sf_dir)
    return R.orbital_couplings(rows, R.orbital_matrix(rows, F.col("orb") + 1)).select("id", "orb", "same", "l1", "l2", F.round("v", 9).alias("v"))


@query(f"WITH {FOCK} SELECT x.id, x.orb, round(sum(f.v * x.c * y.c), 9) AS energy FROM o x JOIN o y ON x.id = y.id AND x.orb = y.orb JOIN f ON f.id = x.id AND f.a = x.ao AND f.b = y.ao GROUP BY 1, 2")
def orbital_energies(spark, sf_dir):
    rows = _lines(spark, sf_dir)
    return R.orbital_energies(rows, R.orbital_matrix(rows, F.col("orb") + 1)).select("id", "orb", F.round("energy", 9).alias("energy"))


@query(f"""WITH {LINES}, s AS (SELECT *, bool_or(orb = 0) OVER (PARTITION BY id) AS taken FROM o)
SELECT id, CASE WHEN taken THEN atom ELSE -1 END AS atom, count(*) AS parts, min(ao) AS first, round(sum(c), 6) AS c FROM s WHERE NOT taken OR orb = 0 GROUP BY 1, 2""")
def pseudo_orbitals(spark, sf_dir):
    """What occupied orbitals (those with the number 0) have at each atom."""
    found = R.pseudo_orbitals(_lines(spark, sf_dir).withColumn("occupied", F.col("orb") == 0))
    c = V.total(F.transform("parts", lambda p: p["c"]))
    return found.select("id", F.coalesce("atom", F.lit(-1)).alias("atom"), F.size("parts").cast("long").alias("parts"), F.array_min(F.transform("parts", lambda p: p["ao"])).alias("first"), r6(c).alias("c"))


@query("""WITH c AS (SELECT c_mktsegment AS id, c_nationkey AS part, CAST(floor(c_acctbal / 2500) AS DOUBLE) AS level, CAST(count(*) AS DOUBLE) AS rho FROM customer GROUP BY 1, 2, 3),
p AS (SELECT a.id AS i, b.id AS j, a.rho * b.rho AS w, pow(a.level - b.level, 2) + pow(a.rho / 10 - b.rho / 10, 2) AS d FROM c a JOIN c b ON a.id <= b.id)
SELECT i, j, round(sum(w * exp(-d / 4)), 4) AS k, round(sum(w * exp(-d / 4) * d / 2), 4) AS dk FROM p GROUP BY 1, 2""")
def orbital_kernel_dsigma(spark, sf_dir):
    parts = _parts(spark, sf_dir)
    return O.molecule_kernel(parts, 1.0, blocks(parts), slope=True).select("i", "j", F.round("k", 4).alias("k"), F.round("dk", 4).alias("dk"))


@query("""WITH c AS (SELECT c_mktsegment AS id, c_nationkey AS part, CAST(floor(c_acctbal / 2500) AS DOUBLE) AS level, CAST(count(*) AS DOUBLE) AS rho FROM customer GROUP BY 1, 2, 3),
p AS (SELECT a.id AS i, b.id AS j, sum(a.rho * b.rho * exp(-(pow(a.level - b.level, 2) + pow(a.rho / 10 - b.rho / 10, 2)) / 4)) AS k FROM c a JOIN c b ON a.id <= b.id GROUP BY 1, 2)
SELECT p.i, p.j, round(exp(-(1 - p.k / sqrt(x.k * y.k)) / 0.25), 6) AS k FROM p JOIN p x ON x.i = p.i AND x.j = p.i JOIN p y ON y.i = p.j AND y.j = p.j""")
def orbital_global_gaussian(spark, sf_dir):
    """The Gaussian, of width one half, of kernels normalised by molecules."""
    parts = _parts(spark, sf_dir)
    return O.global_gaussian(O.molecule_kernel(parts, 1.0, blocks(parts)), 0.5).select("i", "j", r6("k").alias("k"))
