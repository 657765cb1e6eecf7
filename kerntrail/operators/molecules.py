"""Labelled graphs with hydrogens: filling, counting, comparing and changing them, as joins over all graphs at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import vectors as V
from ..storage import staged
from . import canonical as C
from . import graphs as G


def filled(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """atoms with neighbours, used (sum of bond orders), valence and hydrogens: each takes the least valence that its bonds allow.

    valence and hydrogens are NULL where there is none.
    """
    found = G.degrees(atoms.select("graph", "atom", "z"), bonds).withColumnRenamed("valence", "used")
    return found.withColumn("valence", S.least_valence(F.col("z"), F.col("used"))).withColumn("hydrogens", (F.col("valence") - F.col("used")).cast("int"))


def with_hydrogens(atoms: DataFrame, bonds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """filled() atoms and their bonds -> all atoms and bonds: hydrogens follow the heavy atoms, in the order of their owners."""
    order = Window.partitionBy("graph").orderBy("atom")
    behind = order.rowsBetween(Window.unboundedPreceding, -1)
    first = F.max("atom").over(Window.partitionBy("graph")) + F.coalesce(F.sum("hydrogens").over(behind), F.lit(0)) + 1
    placed = atoms.withColumn("first", first).filter("hydrogens > 0")
    own = placed.select("graph", F.col("atom").alias("a"), F.explode(F.sequence("first", F.col("first") + F.col("hydrogens") - 1)).alias("b"))
    every = atoms.select("graph", F.col("atom").cast("long").alias("atom"), "z").unionByName(own.select("graph", F.col("b").alias("atom"), F.lit(1).alias("z")))
    edges = bonds.select("graph", F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), F.col("order").cast("long").alias("order"))
    return every, edges.unionByName(own.select("graph", F.col("a").cast("long").alias("a"), "b", F.lit(1).cast("long").alias("order")))


def unprotonated(atoms: DataFrame, elements: list[int]) -> DataFrame:
    """Graphs of filled() atoms in which none of the elements has a hydrogen."""
    bad = atoms.filter(F.col("z").isin(elements) & (F.col("hydrogens") > 0)).select("graph").distinct()
    return atoms.select("graph").distinct().join(bad, "graph", "left_anti")


def coordination(atoms: DataFrame) -> DataFrame:
    """filled() atoms with coordination (neighbours and hydrogens), effective (and unshared pairs) and hybridisation."""
    every = atoms.withColumn("coordination", F.col("neighbours") + F.coalesce("hydrogens", F.lit(0)))
    effective = F.col("coordination") + F.coalesce(S.unshared_pairs(F.col("z"), F.col("valence")), F.lit(0))
    return every.withColumn("effective", effective).withColumn("hybridisation", S.hybridisation(F.col("effective")))


def totals(atoms: DataFrame) -> DataFrame:
    """filled() atoms -> graph, heavy, hydrogens, covalent (bonding pairs, those to hydrogens too)."""
    return atoms.groupBy("graph").agg(
        F.count(F.lit(1)).alias("heavy"), F.sum(F.coalesce("hydrogens", F.lit(0))).alias("hydrogens"),
        (F.floor(F.sum("used") / 2) + F.sum(F.coalesce("hydrogens", F.lit(0)))).alias("covalent"),
    )


def hydrogenation(atoms: DataFrame, totals: DataFrame, hydrides: dict[int, float], hydrogen: float) -> DataFrame:
    """totals(graph, energy) -> graph, energy: that of the reaction from hydrides of all its atoms, which sets hydrogen free.

    energy - the sum of the hydrides' energies + half a hydrogen molecule's for each hydrogen that the graph has less.
    """
    free = F.sum(S.least_valence(F.col("z"), F.lit(0)) - F.coalesce("hydrogens", F.lit(0)))
    sums = atoms.groupBy("graph").agg(F.sum(V.lookup(hydrides, F.col("z"))).alias("hydrides"), free.alias("free"))
    return totals.join(sums, "graph").select("graph", (F.col("energy") - F.col("hydrides") + hydrogen * F.col("free") / 2).alias("energy"))


def unique(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """One graph for each key, the one with the least id, and how many share it: (graph, copies)."""
    return C.graph_keys(atoms, bonds).groupBy("key").agg(F.min("graph").alias("graph"), F.count(F.lit(1)).alias("copies")).select("graph", "copies")


def carbonised(atoms: DataFrame, bonds: DataFrame, target: int = 6) -> DataFrame:
    """atoms with every element replaced by the target where the target's greatest valence allows the atom's bonds."""
    most = max(V.VALENCES[target])
    used = G.degrees(atoms.select("graph", "atom", "z"), bonds)
    return used.select("graph", "atom", F.when(F.col("valence") <= most, target).otherwise(F.col("z")).alias("z"))


def carbonised_unique(atoms: DataFrame, bonds: DataFrame, target: int = 6) -> DataFrame:
    """(graph, tier): graphs of the target element alone first, one for each key (tier 0); of the others, in the order of ids, those
    whose key and whose carbonised key none has yet (tier 1).

    The others' carbonised keys decide: an equal graph has an equal one too, so the first of each is enough.
    """
    marked = staged(C.carbonised_keys(atoms, bonds, target, max(V.VALENCES[target])), "carbonised")
    first = marked.filter("pure").groupBy("key").agg(F.min("graph").alias("graph"))
    others = marked.filter("NOT pure").join(first.select(F.col("key").alias("bare")), "bare", "left_anti")
    second = others.groupBy("bare").agg(F.min("graph").alias("graph"))
    return first.select("graph", F.lit(0).alias("tier")).unionByName(second.select("graph", F.lit(1).alias("tier")))


def shuffled(atoms: DataFrame, bonds: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """The same graphs with their atoms renumbered, from 1, in the order of a seeded hash."""
    order = Window.partitionBy("graph").orderBy(F.xxhash64("graph", "atom", F.lit(seed)), "atom")
    new = atoms.select("graph", "atom", "z", F.row_number().over(order).alias("new"))
    number = new.select("graph", F.col("atom").alias("old"), "new")
    ends = bonds.join(number.toDF("graph", "a", "x"), ["graph", "a"]).join(number.toDF("graph", "b", "y"), ["graph", "b"])
    return new.select("graph", F.col("new").alias("atom"), "z"), ends.select("graph", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "order")


def transferred_classes(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """(graph, atom, model, class): atoms' classes named by atoms of the first graph with the same key (the smallest of its own class)."""
    own = C.labelled(atoms, bonds)
    first = own.filter("place = 0").groupBy("key").agg(F.min("graph").alias("model"))
    named = own.join(first, "key")
    there = named.filter("graph = model").select("model", "place", F.col("orbit").alias("class"))
    return named.select("graph", "atom", "model", "place").join(there, ["model", "place"]).select("graph", "atom", "model", "class")


def fragments(atoms: DataFrame, bonds: DataFrame, cut: DataFrame) -> DataFrame:
    """(graph, atom, fragment, place): what is left of graphs without the bonds cut(graph, a, b); a fragment is named by its smallest
    atom, and its atoms are numbered anew from 1."""
    parts = G.components(atoms, bonds.join(cut, ["graph", "a", "b"], "left_anti"))
    place = F.row_number().over(Window.partitionBy("graph", "component").orderBy("atom"))
    return parts.select("graph", "atom", F.col("component").alias("fragment"), place.alias("place"))


def pair_classes(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """(graph, class_a, class_b, d, pairs): ordered pairs of atoms by both classes (as equivalence() names them) and the bonds between them.

    canonical.pair_orbits() tells pairs apart as symmetries do, which is finer.
    """
    named = C.labelled(atoms, bonds).select("graph", "atom", F.col("orbit").alias("class"))
    paths = G.distances(atoms, bonds).filter("a <> b").select("graph", "a", "b", "d")
    both = paths.join(named.toDF("graph", "a", "class_a"), ["graph", "a"]).join(named.toDF("graph", "b", "class_b"), ["graph", "b"])
    return both.groupBy("graph", "class_a", "class_b", "d").agg(F.count(F.lit(1)).alias("pairs"))


def masked_distances(atoms: DataFrame, bonds: DataFrame, most: int, radii: dict[int, float] | None = None) -> DataFrame:
    """distances() over bonds whose atoms both have an effective coordination of `most` at most; atoms is coordination()'s."""
    fit = atoms.filter(F.col("effective") <= most).select("graph", "atom")
    kept = bonds.join(fit.toDF("graph", "a"), ["graph", "a"], "left_semi").join(fit.toDF("graph", "b"), ["graph", "b"], "left_semi")
    return G.distances(atoms.select("graph", "atom", "z"), kept, radii)


def hydrogen_surroundings(atoms: DataFrame, bonds: DataFrame, n: int) -> DataFrame:
    """(graph, atom, hydrogens, near, d): for heavy atoms with hydrogens the n heavy atoms that are nearest to these, in order (ties:
    smaller numbers), and their distances from the hydrogen in bonds, padded with 0."""
    heavy = atoms.filter("hydrogens > 0").select("graph", F.col("atom").alias("a"), "hydrogens")
    paths = G.distances(atoms.select("graph", "atom", "z"), bonds).join(heavy, ["graph", "a"])
    ranked = paths.groupBy("graph", "a", "hydrogens").agg(F.slice(F.array_sort(F.collect_list(F.struct((F.col("d") + 1).alias("d"), "b"))), 1, n).alias("near"))
    return ranked.select("graph", F.col("a").alias("atom"), "hydrogens", F.transform("near", lambda s: s["b"]).alias("near"), V.padded(F.transform("near", lambda s: s["d"]), n).alias("d"))


def matching_fragments(couples: DataFrame, fragments: DataFrame) -> DataFrame:
    """couples(left, right) of fragments(id, orders array: the orders of its cut bonds) -> (left, right, ways): those that can be joined.

    They match if their orders are the same multiset; ways: how many pairings of the cuts join equal orders.
    """
    own = fragments.filter(F.size("orders") > 0).select("id", F.array_sort("orders").alias("orders"))
    met = couples.join(own.toDF("left", "orders"), "left").join(own.toDF("right", "others"), "right").filter(F.col("orders") == F.col("others"))
    many = F.transform(F.array_distinct("orders"), lambda x: F.size(F.filter("orders", lambda y: y == x)))
    return met.select("left", "right", F.aggregate(many, F.lit(1).cast("long"), lambda p, k: p * F.factorial(k)).alias("ways"))


def moves(atoms: DataFrame, bonds: DataFrame, elements: list[int]) -> DataFrame:
    """(graph, kind, a, b, value): all changes of filled() atoms and their bonds that valences allow, b NULL where one atom changes.

    add: an atom of element `value` in the place of a hydrogen; remove: an atom with one neighbour; replace: another element
    whose valences allow the atom's bonds; bond: an order by one more (b may be no neighbour yet) or, down to 1, less;
    valence: the next valence up (more hydrogens) or down (fewer); valence_add: the next valence up, spent on one new atom;
    valence_remove: the next valence down, by removing a neighbour that is bound so and no other; valence_bond: the
    next valence up, spent on the bond to a neighbour, as its hydrogens allow.
    """
    atoms = atoms.withColumn("hydrogens", F.coalesce("hydrogens", F.lit(0)))
    options = F.array(*map(F.lit, elements))
    greatest = lambda z: F.array_max(V.lookup(V.VALENCES, z))
    up, down = S.next_valence(F.col("z"), F.col("valence")), S.next_valence(F.col("z"), F.col("valence"), up=False)
    nobody = F.lit(None).cast("int")

    def move(rows: DataFrame, kind: str, value, b=nobody) -> DataFrame:
        return rows.select("graph", F.lit(kind).alias("kind"), F.col("atom").cast("int").alias("a"), b.cast("int").alias("b"), value.alias("value"))

    free = atoms.filter("hydrogens > 0")
    raised, lowered = atoms.withColumn("next", up).filter("next IS NOT NULL"), atoms.withColumn("next", down).filter("next IS NOT NULL")
    found = [
        move(free, "add", F.explode(options)),
        move(atoms.filter("neighbours = 1"), "remove", F.col("z")),
        move(atoms, "replace", F.explode(F.filter(options, lambda z: (z != F.col("z")) & (greatest(z) >= F.col("used"))))),
        move(raised, "valence", F.col("next")),
        move(lowered.filter(F.col("hydrogens") >= F.col("valence") - F.col("next")), "valence", F.col("next")),
        move(raised, "valence_add", F.explode(F.filter(options, lambda z: greatest(z) >= F.col("next") - F.col("valence")))),
    ]
    end = atoms.select("graph", F.col("atom").alias("b"), F.col("hydrogens").alias("hb"), F.col("neighbours").alias("nb"))
    ordered = free.select("graph", "atom", "hydrogens").join(end.filter("hb > 0"), "graph").filter("atom < b")
    known = bonds.select("graph", F.col("a").alias("atom"), "b", "order")
    met = ordered.join(known, ["graph", "atom", "b"], "left").filter("order IS NULL OR order < 3")
    found.append(move(met, "bond", (F.coalesce("order", F.lit(0)) + 1).cast("int"), F.col("b")))
    found.append(move(known.filter("order > 1"), "bond", (F.col("order") - 1).cast("int"), F.col("b")))
    near = G.directed(bonds).select("graph", F.col("a").alias("atom"), "b", "order").join(end, ["graph", "b"])
    step = F.col("next") - F.col("valence")
    found.append(move(lowered.join(near.filter("nb = 1"), ["graph", "atom"]).filter(F.col("order") == -step), "valence_remove", F.col("next"), F.col("b")))
    found.append(move(raised.join(near, ["graph", "atom"]).filter((F.col("hb") >= step) & (F.col("order") + step <= 3)), "valence_bond", F.col("next"), F.col("b")))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
