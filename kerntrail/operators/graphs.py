"""Labelled graphs as tables: atoms(graph, atom, z) and bonds(graph, a, b, order) with a < b. Every operator works on all graphs at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..storage import staged


#: Atoms of a graph up to which it is one row inside a task; greater graphs go through joins of their atoms and bonds.
WHOLE = 256
#: Cells of matrices that a task holds at once.
CELLS = 1 << 21


def split(atoms: DataFrame, bonds: DataFrame, most: int = WHOLE) -> tuple[tuple[DataFrame, DataFrame], tuple[DataFrame, DataFrame] | None]:
    """The atoms and bonds of graphs with up to `most` atoms, and of the others, if there are any."""
    greater = staged(atoms.groupBy("graph").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).select("graph"), "great-graphs")
    if not greater.limit(1).count():
        return (atoms, bonds), None
    return tuple(x.join(greater, "graph", "left_anti") for x in (atoms, bonds)), tuple(x.join(greater, "graph", "left_semi") for x in (atoms, bonds))


def per_graph(atoms: DataFrame, bonds: DataFrame, work: Callable[[dict[str, np.ndarray]], pa.Table | Iterator[pa.Table]], schema: str) -> DataFrame:
    """work(...) of many whole graphs at a time, a table or several one after the other. It gets arrays: graph and size by graph; start: its first atom's place; atom and z by atom;
    of, a, b, order by bond (its graph's number, places of its atoms, its order)."""
    lists = atoms.groupBy("graph").agg(F.array_sort(F.collect_list(F.struct("atom", "z"))).alias("atoms"))
    edges = bonds.groupBy("graph").agg(F.collect_list(F.struct(F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"), F.col("order").cast("double").alias("order"))).alias("bonds"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = np.cumsum(np.diff(batch["atoms"].offsets.to_numpy()).astype(np.int64) ** 2)
            cuts = np.unique(np.searchsorted(cells, np.arange(0, cells[-1] if len(cells) else 0, CELLS)))
            for k, m in zip(cuts, [*cuts[1:], batch.num_rows], strict=True):
                found = work(arrays(batch.slice(k, m - k)))
                for table in (found,) if isinstance(found, pa.Table) else found:
                    yield from table.to_batches()

    return lists.join(edges, "graph", "left").select("graph", "atoms", F.coalesce("bonds", F.array().cast("array<struct<a:int,b:int,order:double>>")).alias("bonds")).mapInArrow(run, schema)


def arrays(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    own, edges = batch["atoms"].flatten(), batch["bonds"].flatten()
    size, many = (np.diff(batch[c].offsets.to_numpy()).astype(np.int64) for c in ("atoms", "bonds"))
    start, of = np.cumsum(size) - size, np.repeat(np.arange(len(size)), many)
    atom, owner = own.field("atom").to_numpy().astype(np.int64), np.repeat(np.arange(len(size)), size)
    # atoms by graph and number, to find bonds' ends
    low, wide = (int(atom.min()), int(atom.max()) - int(atom.min()) + 1) if len(atom) else (0, 1)
    keys = owner * wide + atom - low
    ends = [np.searchsorted(keys, of * wide + edges.field(c).to_numpy().astype(np.int64) - low) for c in ("a", "b")]
    return {
        "graph": batch["graph"].to_numpy(), "size": size, "start": start, "atom": atom, "z": own.field("z").to_numpy(), "owner": owner,
        "of": of, "a": ends[0], "b": ends[1], "order": edges.field("order").to_numpy().astype(float),
    }


def directed(bonds: DataFrame) -> DataFrame:
    return bonds.unionByName(bonds.select("graph", F.col("b").alias("a"), F.col("a").alias("b"), "order"))


def degrees(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """(graph, atom, z, neighbours, valence): coordination number and sum of bond orders, 0 for lone atoms."""
    sums = directed(bonds).groupBy("graph", F.col("a").alias("atom")).agg(F.count(F.lit(1)).alias("neighbours"), F.sum("order").alias("valence"))
    return atoms.join(sums, ["graph", "atom"], "left").fillna(0, ["neighbours", "valence"])


def stoichiometry(atoms: DataFrame) -> DataFrame:
    return atoms.groupBy("graph", "z").agg(F.count(F.lit(1)).alias("n"))


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers, well mixed."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def colours(g: dict[str, np.ndarray]) -> pa.Table:
    """refined(...) of whole graphs: each graph stops when its own colours no longer grow in number."""
    colour = mixed(g["z"].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    src, dst = np.append(g["a"], g["b"]), np.append(g["b"], g["a"])
    order = np.append(g["order"], g["order"]).view(np.uint64)
    active, n = np.ones(len(g["size"]), bool), kinds(g["owner"], colour, len(g["size"]))
    while active.any():
        # the multiset of neighbours' colours and bonds as a sum, which no order changes
        around = np.zeros(len(colour), np.uint64)
        np.add.at(around, src, mixed(colour[dst] ^ mixed(order)))
        after = np.where(active[g["owner"]], mixed(colour * np.uint64(0x9E3779B97F4A7C15) + around), colour)
        now = kinds(g["owner"], after, len(g["size"]))
        colour, active, n = after, active & (now > n), now
    return pa.table({"graph": g["graph"][g["owner"]], "atom": g["atom"].astype(np.int32), "colour": colour.view(np.int64)})


def kinds(owner: np.ndarray, colour: np.ndarray, graphs: int) -> np.ndarray:
    """How many colours each graph has."""
    order = np.lexsort((colour, owner))
    new = np.append(True, (np.diff(owner[order]) != 0) | (np.diff(colour[order]) != 0)) if len(owner) else np.zeros(0, bool)
    return np.bincount(owner[order][new], minlength=graphs)


def refined(atoms: DataFrame, bonds: DataFrame, most: int = WHOLE) -> DataFrame:
    """(graph, atom, colour): colours from elements, then in each round from the colours of neighbours and the bonds to them.

    Rounds go on until the number of colours no longer grows. Atoms that a renumbering maps to each other always get one
    colour; graphs that differ in numbering only get the same ones. Graphs of up to `most` atoms are refined whole inside a
    task, greater ones by joins.
    """
    (atoms, bonds), great = split(atoms.select("graph", "atom", "z"), bonds, most)
    found = per_graph(atoms, bonds, colours, "graph long, atom int, colour long")
    return found if great is None else found.unionByName(refined_by_joins(*great).select("graph", F.col("atom").cast("int").alias("atom"), "colour"))


def refined_by_joins(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """The same by a join of all graphs' bonds with their atoms' colours in each round; a graph is left alone when its own colours no longer grow."""
    edges = directed(bonds)

    def counted(colour: DataFrame, before: DataFrame | None) -> DataFrame:
        n = colour.groupBy("graph").agg(F.count_distinct("colour").alias("n"))
        if before is None:
            return staged(n.withColumn("active", F.lit(True)), "kinds")
        return staged(n.join(before.select("graph", F.col("n").alias("was"), F.col("active").alias("grew")), "graph").select("graph", "n", (F.col("grew") & (F.col("n") > F.col("was"))).alias("active")), "kinds")

    colour = staged(atoms.select("graph", "atom", F.xxhash64("z").alias("colour")), "colours")
    kinds = counted(colour, None)
    while not kinds.filter("active").isEmpty():
        going = kinds.filter("active").select("graph", F.lit(True).alias("going"))
        seen = edges.join(going, "graph", "left_semi").join(colour.withColumnRenamed("atom", "b"), ["graph", "b"])
        seen = seen.groupBy("graph", F.col("a").alias("atom")).agg(F.array_sort(F.collect_list(F.xxhash64("order", "colour"))).alias("around"))
        after = F.xxhash64("colour", F.coalesce("around", F.array().cast("array<bigint>")))
        joined = colour.join(going, "graph", "left").join(seen, ["graph", "atom"], "left")
        colour = staged(joined.select("graph", "atom", F.when(F.col("going"), after).otherwise(F.col("colour")).alias("colour")), "colours")
        kinds = counted(colour, kinds)
    return colour


def reached(g: dict[str, np.ndarray]) -> pa.Table:
    """components(...) of whole graphs."""
    label = np.arange(len(g["z"]))
    while True:
        before = label.copy()
        np.minimum.at(label, g["a"], label[g["b"]])
        np.minimum.at(label, g["b"], label[g["a"]])
        label = label[label]
        if np.array_equal(label, before):
            break
    number = g["atom"].astype(np.int32)
    return pa.table({"graph": g["graph"][g["owner"]], "atom": number, "component": number[label]})


def components(atoms: DataFrame, bonds: DataFrame, most: int = WHOLE) -> DataFrame:
    """(graph, atom, component): the smallest atom that each reaches; whole graphs of up to `most` atoms in a task, greater ones by joins."""
    (atoms, bonds), great = split(atoms.select("graph", "atom", "z"), bonds, most)
    found = per_graph(atoms, bonds, reached, "graph long, atom int, component int")
    return found if great is None else found.unionByName(components_by_joins(*great).select("graph", *[F.col(c).cast("int").alias(c) for c in ("atom", "component")]))


def components_by_joins(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """The same: labels sink along bonds until none changes."""
    edges = directed(bonds).select("graph", "a", "b")
    label = atoms.select("graph", "atom", F.col("atom").alias("component"))
    while True:
        near = edges.join(label.withColumnRenamed("atom", "b"), ["graph", "b"]).groupBy("graph", F.col("a").alias("atom")).agg(F.min("component").alias("near"))
        low = label.join(near, ["graph", "atom"], "left").select("graph", "atom", F.col("component").alias("was"), F.least("component", "near").alias("low"))
        jump = low.select("graph", F.col("atom").alias("low"), F.col("low").alias("component"))
        after = staged(low.join(jump, ["graph", "low"]).select("graph", "atom", "was", "component"), "components")
        label = after.select("graph", "atom", "component")
        if not after.filter("was <> component").limit(1).count():
            return label


def path_matrices(g: dict[str, np.ndarray], ra: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(atoms, graphs, matrices of shortest paths) of whole graphs, those of one size together: each atom in turn is tried as a stop of all paths."""
    inside = np.arange(len(g["z"])) - g["start"][g["owner"]]
    for n in np.unique(g["size"]):
        own = np.flatnonzero(g["size"] == n)
        number = np.full(len(g["size"]), -1)
        number[own] = np.arange(len(own))
        d = np.full((len(own), n, n), np.inf)
        some = number[g["of"]] >= 0
        k, a, b = number[g["of"][some]], inside[g["a"][some]], inside[g["b"][some]]
        length = ra[g["a"][some]] + ra[g["b"][some]]
        np.minimum.at(d, (k, a, b), length)
        np.minimum.at(d, (k, b, a), length)
        d[:, np.arange(n), np.arange(n)] = 0
        for k in range(n):
            np.minimum(d, d[:, :, k, None] + d[:, k, None, :], out=d)
        yield n, own, d


def paths(radii: dict[int, float] | None) -> Callable[[dict[str, np.ndarray]], pa.Table]:
    """distances(...) of whole graphs."""

    def work(g: dict[str, np.ndarray]) -> pa.Table:
        ra = np.array([radii.get(int(z), np.nan) for z in g["z"]]) if radii else np.full(len(g["z"]), 0.5)
        out = []
        for _, own, d in path_matrices(g, ra):
            k, a, b = np.nonzero(np.isfinite(d))
            at = g["start"][own][k]
            out.append([g["graph"][own][k], g["atom"][at + a], g["atom"][at + b], np.round(d[k, a, b], 9), g["z"][at + a], g["z"][at + b]])
        graph, a, b, d, za, zb = (np.concatenate(x) for x in zip(*out, strict=True)) if out else [np.zeros(0, np.int64)] * 6
        return pa.table({"graph": graph, "a": a.astype(np.int32), "b": b.astype(np.int32), "d": d.astype(float), "za": za.astype(np.int32), "zb": zb.astype(np.int32)})

    return work


PATHS = "graph long, a int, b int, d double, za int, zb int"


def distances(atoms: DataFrame, bonds: DataFrame, radii: dict[int, float] | None = None, most: int = WHOLE) -> DataFrame:
    """(graph, a, b, d, za, zb): shortest paths between all pairs of a graph's atoms that have one, in bonds or, with radii, in lengths.

    Graphs of up to `most` atoms are worked out whole inside a task; greater ones by joins.
    """
    (atoms, bonds), great = split(atoms.select("graph", "atom", "z"), bonds, most)
    found = per_graph(atoms, bonds, paths(radii), PATHS)
    return found if great is None else found.unionByName(distances_by_joins(*great, radii))


def distances_by_joins(atoms: DataFrame, bonds: DataFrame, radii: dict[int, float] | None = None) -> DataFrame:
    """The same: paths double in length in each round, as a shortest path of up to 2^k bonds is two of up to 2^(k-1).

    It ends when no pair is new and no path became shorter (by more than a part in a billion, which sums in another order may differ by).
    """
    length = F.lit(1.0)
    edges = directed(bonds)
    if radii:
        z = atoms.select("graph", F.col("atom").alias("a"), V.lookup(radii, F.col("z")).alias("ra"))
        edges = edges.join(z, ["graph", "a"]).join(z.toDF("graph", "b", "rb"), ["graph", "b"])
        length = F.col("ra") + F.col("rb")
    best = edges.select("graph", "a", "b", length.alias("d")).unionByName(atoms.select("graph", F.col("atom").alias("a"), F.col("atom").alias("b"), F.lit(0.0).alias("d")))
    best = staged(best.groupBy("graph", "a", "b").agg(F.min("d").alias("d")).withColumn("changed", F.lit(True)), "paths")
    while best.filter("changed").limit(1).count():
        first = best.select("graph", "a", F.col("b").alias("m"), F.col("d").alias("d1"), F.col("changed").alias("c1"))
        second = best.select("graph", F.col("a").alias("m"), "b", F.col("d").alias("d2"), F.col("changed").alias("c2"))
        longer = first.join(second, ["graph", "m"]).filter("c1 OR c2").groupBy("graph", "a", "b").agg(F.min(F.col("d1") + F.col("d2")).alias("e"))
        shorter = F.col("d").isNull() | (F.col("e") < F.col("d") * (1 - 1e-9))
        both = best.drop("changed").join(longer, ["graph", "a", "b"], "full")
        best = staged(both.select("graph", "a", "b", F.when(shorter, F.col("e")).otherwise(F.col("d")).alias("d"), F.coalesce(shorter & F.col("e").isNotNull(), F.lit(False)).alias("changed")), "paths")
    za, zb = (atoms.select("graph", F.col("atom").alias(c), F.col("z").alias("z" + c)) for c in "ab")
    found = best.join(za, ["graph", "a"]).join(zb, ["graph", "b"])
    return found.select("graph", F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"), F.round("d", 9).alias("d"), F.col("za").cast("int").alias("za"), F.col("zb").cast("int").alias("zb"))


def coulomb(paths: DataFrame) -> DataFrame:
    """(graph, a, b, v) of paths(graph, a, b, d, za, zb): z_a z_b / d, 0.5 z^2.4 on the diagonal; pairs without a path are 0 and left out."""
    value = F.when(F.col("a") == F.col("b"), 0.5 * F.pow(F.col("za").cast("double"), 2.4)).otherwise(F.col("za") * F.col("zb") / F.col("d"))
    return paths.select("graph", "a", "b", value.alias("v"))


def descriptor(entries: DataFrame, size: int) -> DataFrame:
    """entries(graph, a, b, v) -> graph, x: rows and columns in the order of falling row norms, padded to `size`, the upper triangle.

    Atoms of equal norms stay in order; a graph with more atoms than `size` loses those with the least norms, so take greatest(...) where none may.
    """
    rows = entries.groupBy("graph", "a").agg(F.array_sort(F.collect_list(F.struct("b", "v"))).alias("r"))
    rows = rows.select("graph", F.struct("a", F.transform("r", lambda s: s["v"]).alias("r")).alias("row"))
    square = rows.groupBy("graph").agg(F.array_sort(F.collect_list("row")).alias("m"))
    keyed = F.array_sort(F.transform("m", lambda s, i: F.struct((-V.norm(s["r"])).alias("n"), i.alias("i"), s["r"].alias("r"))))
    turned = F.transform("k", lambda s: V.padded(F.transform(F.transform("k", lambda t: t["i"]), lambda i: F.get(s["r"], i)), size))
    matrix = F.slice(F.concat(turned, F.array_repeat(F.array_repeat(F.lit(0.0), size), size)), 1, size)
    return square.select("graph", keyed.alias("k")).select("graph", V.upper_triangle(matrix).alias("x"))


def descriptor_totals(atoms: DataFrame, bonds: DataFrame, size: int, most: int = WHOLE) -> DataFrame:
    """(graph, n, hops, orders): how many atoms a graph has, and the sums of its descriptors from distances in bonds and from bond orders.

    Graphs of up to `most` atoms have both matrices inside a task, so no row for each pair of atoms leaves it; greater ones go through joins.
    """

    def work(g: dict[str, np.ndarray]) -> pa.Table:
        out, inside = np.zeros((2, len(g["size"]))), np.arange(len(g["z"])) - g["start"][g["owner"]]
        for n, own, hops in path_matrices(g, np.full(len(g["z"]), 0.5)):
            number = np.full(len(g["size"]), -1)
            number[own] = np.arange(len(own))
            some = number[g["of"]] >= 0
            k, a, b, orders = number[g["of"][some]], inside[g["a"][some]], inside[g["b"][some]], np.zeros(hops.shape)
            orders[k, a, b] = orders[k, b, a] = g["order"][some]
            for c, m in enumerate((np.where(np.isfinite(hops), np.round(hops, 9), 0.0), orders)):
                first = np.argsort(-np.sqrt((m * m).sum(axis=2)), axis=1, kind="stable")[:, :size]
                m = np.take_along_axis(np.take_along_axis(m, first[:, :, None], 1), first[:, None, :], 2)
                out[c, own] = m[:, *np.triu_indices(m.shape[1])].sum(axis=1)
        return pa.table({"graph": g["graph"], "n": g["size"].astype(np.int64), "hops": out[0], "orders": out[1]})

    (atoms, bonds), great = split(atoms.select("graph", "atom", "z"), bonds, most)
    found = per_graph(atoms, bonds, work, "graph long, n long, hops double, orders double")
    if great is None:
        return found
    atoms, bonds = great
    every = distances_by_joins(atoms, bonds)
    order = every.select("graph", "a", "b").join(directed(bonds), ["graph", "a", "b"], "left").select("graph", "a", "b", F.coalesce(F.col("order").cast("double"), F.lit(0.0)).alias("v"))
    sums = [descriptor(x, size).select("graph", V.total(F.col("x")).alias(c)) for c, x in (("hops", every.select("graph", "a", "b", F.col("d").alias("v"))), ("orders", order))]
    return found.unionByName(atoms.groupBy("graph").agg(F.count(F.lit(1)).alias("n")).join(sums[0], "graph").join(sums[1], "graph"))


def averaged_bonds(structures: DataFrame, lengths: dict[int, float]) -> DataFrame:
    """structures(graph, structure, a, b, order), the same bonds in each structure of a graph -> (graph, a, b, order, length).

    Orders are means over structures; lengths are interpolated between those of the whole orders around them.
    """
    return interpolated(structures.groupBy("graph", "a", "b").agg(F.avg("order").alias("order")), lengths)


def interpolated(mean: DataFrame, lengths: dict[int, float]) -> DataFrame:
    """mean(graph, a, b, order) with the length of each bond, interpolated between those of the whole orders around its own."""
    low, high = F.floor("order").cast("int"), F.ceil("order").cast("int")
    at = lambda k: V.lookup(lengths, k)
    return mean.withColumn("length", at(low) + (F.col("order") - low) * (at(high) - at(low)))


def admissible(atoms: DataFrame, bonds: DataFrame, forbidden: DataFrame, size: tuple[int, int], allowed: list[int]) -> DataFrame:
    """Graphs with allowed elements, a size in the range and no bond between a forbidden(z1, z2) pair of elements."""
    sized = atoms.groupBy("graph").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("z").isin(allowed)).alias("known"))
    good = sized.filter(F.col("n").between(*size) & F.col("known")).select("graph")
    za, zb = atoms.toDF("graph", "a", "za"), atoms.toDF("graph", "b", "zb")
    pairs = bonds.join(za, ["graph", "a"]).join(zb, ["graph", "b"]).select("graph", F.least("za", "zb").alias("z1"), F.greatest("za", "zb").alias("z2"))
    bad = pairs.join(F.broadcast(forbidden), ["z1", "z2"]).select("graph")  # a pair of elements for each row
    return good.join(bad, "graph", "left_anti")


def energies(atoms: DataFrame, by_element: dict[int, float], by_valence: dict[int, int], totals: DataFrame) -> DataFrame:
    """totals(graph, energy) -> atomisation energy (energy less the atoms'), and that by the sum of valences."""
    sums = atoms.groupBy("graph").agg(F.sum(V.lookup(by_element, F.col("z"))).alias("apart"), F.sum(V.lookup(by_valence, F.col("z"))).alias("bonds"))
    return totals.join(sums, "graph").select("graph", (F.col("energy") - F.col("apart")).alias("atomisation"), ((F.col("energy") - F.col("apart")) / F.col("bonds")).alias("normalised"))
