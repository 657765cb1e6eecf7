"""Operators on records: filters of atoms, lookups of keys, neighbours of states, crossings, hulls, fits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import staged


def heavy_atoms(atoms: DataFrame, light: int, least: int = 4) -> DataFrame:
    """Atoms without those of the light element, in graphs that keep `least` others at least; all atoms of other graphs."""
    others = F.sum((F.col("z") != light).cast("int")).over(Window.partitionBy("graph"))
    return atoms.withColumn("others", others).filter((F.col("others") < least) | (F.col("z") != light)).drop("others")


def resorted(atoms: DataFrame) -> DataFrame:
    """atoms with `place`, counted from 1: the greatest charge first, equal ones in order."""
    return atoms.withColumn("place", F.row_number().over(Window.partitionBy("graph").orderBy(F.desc("z"), "atom")))


def every_nth(rows: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """The first row of each group in the given order, and each n-th behind it."""
    k = F.row_number().over(Window.partitionBy(group).orderBy(order))
    return rows.withColumn("k", k).filter(F.col("k") % n == 1).drop("k")


def renumbered(rows: DataFrame, order: str, name: str) -> DataFrame:
    """rows with their place, from 0, in the order of a column without ties, by ranges whose sizes are summed: no task sorts all rows."""
    ranged = staged(rows.repartitionByRange(order).withColumn("part", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row for each task
    inside = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    return ranged.withColumn("inside", inside).join(F.broadcast(before), "part").withColumn(name, F.col("before") + F.col("inside")).drop("part", "before", "inside")


def complete(rows: DataFrame, *needed: str) -> DataFrame:
    """Rows whose needed columns are all known: neither NULL nor NaN."""
    kinds = dict(rows.dtypes)
    for c in needed:
        rows = rows.filter(F.col(c).isNotNull() & (~F.isnan(c) if kinds[c] in ("double", "float") else F.lit(True)))
    return rows


def without(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """The rows whose key isn't among the ids."""
    return rows.join(ids.select(key), key, "left_anti")


def looked_up(states: DataFrame, known: DataFrame, *values: str) -> DataFrame:
    """states(key) with the known values, and whether the key is known."""
    return states.join(known.select("key", *values).withColumn("known", F.lit(True)), "key", "left").fillna(False, ["known"])


def weighted_mean_mae(cells: DataFrame) -> DataFrame:
    """cells(column, ref, p): columns' mean errors over cells whose reference isn't 0, weighted by how many these are."""
    e = cells.filter("ref <> 0").groupBy("column").agg(F.avg(F.abs(F.col("p") - F.col("ref"))).alias("mae"), F.count(F.lit(1)).alias("n"))
    return e.agg((F.sum(F.col("mae") * F.col("n")) / F.sum("n")).alias("mae"), F.sum("n").alias("cells"))


def levels(energies: Column, occupations: Column, threshold: float = 0.1) -> list[Column]:
    """The highest occupied and lowest free level and the gap; NULL where there is none."""
    pairs = F.zip_with(energies, occupations, lambda e, o: F.struct(e.alias("e"), o.alias("o")))
    homo = F.array_max(F.transform(F.filter(pairs, lambda p: p["o"] > threshold), lambda p: p["e"]))
    lumo = F.array_min(F.transform(F.filter(pairs, lambda p: p["o"] <= threshold), lambda p: p["e"]))
    return [homo.alias("homo"), lumo.alias("lumo"), (lumo - homo).alias("gap")]


def discovery_curve(rows: DataFrame, shuffles: int, bins: int) -> DataFrame:
    """rows(id, key) -> (bin, found): how many keys the first bin / bins of the rows hold, on average over so many random orders.

    In an order by numbers in [0, 1) that an MD5 of id and order gives, a key is found at the least number of its rows, so that no
    order is ever sorted.
    """
    orders = F.explode(F.sequence(F.lit(1), F.lit(shuffles))).alias("turn")
    number = F.conv(F.substring(F.md5(F.concat_ws(":", "turn", F.col("id").cast("string"))), 1, 12), 16, 10).cast("double") / float(1 << 48)
    first = rows.select("id", "key", orders).select("key", "turn", number.alias("u")).groupBy("turn", "key").agg(F.min("u").alias("u"))
    counts = first.groupBy((F.floor(F.col("u") * bins) + 1).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    # a row for each bin
    upto = F.sum("n").over(Window.orderBy("bin"))
    return counts.select("bin", (upto / shuffles).alias("found"))


def saturation(curve: DataFrame, steps: int = 100, tolerance: float = 1e-12) -> DataFrame:
    """(a, b) of y = a x / (b + x) by least squares on y, over curve(x, y) with x above 0; NULLs don't count, no rows give NULLs.

    Gauss-Newton steps, damped until the sum of squares falls. Rows of one x are summed first, so a step is one pass over a row for
    each x, and only its five sums reach the driver. It starts at the greatest y and the middle x.
    """
    spark = curve.sparkSession
    known = curve.select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).filter("x > 0 AND y IS NOT NULL")
    points = staged(known.groupBy("x").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("y").alias("sy"), F.sum(F.col("y") * F.col("y")).alias("syy")), "curve")
    start = points.agg(F.max(F.col("sy") / F.col("n")).alias("a"), F.percentile_approx("x", 0.5).alias("b")).first()
    schema = "a double, b double"
    if start["a"] is None:
        return spark.createDataFrame([(None, None)], schema)

    def sums(a: float, b: float):
        """What both parameters' slopes and the residuals sum to."""
        x, n = F.col("x"), F.col("n")
        by_a, by_b = x / (b + x), -a * x / ((b + x) * (b + x))
        rest = F.col("sy") - n * a * x / (b + x)  # of all rows of one x
        left = F.col("syy") - 2 * F.col("sy") * a * x / (b + x) + n * F.pow(a * x / (b + x), F.lit(2))
        return points.agg(F.sum(n * by_a * by_a), F.sum(n * by_a * by_b), F.sum(n * by_b * by_b), F.sum(by_a * rest), F.sum(by_b * rest), F.sum(left)).first()

    a, b, damping = float(start["a"]), float(start["b"]), 0.0
    own = sums(a, b)
    for _ in range(steps):
        aa, ab, bb, ra, rb, square = own
        det = aa * (1 + damping) * bb * (1 + damping) - ab * ab
        if det <= 0:
            if damping > 1e12:
                break
            damping = max(10 * damping, 1e-6)
            continue
        da, db = (bb * (1 + damping) * ra - ab * rb) / det, (aa * (1 + damping) * rb - ab * ra) / det
        there = sums(a + da, b + db) if b + db > 0 else None
        if there is None or there[5] > square * (1 + 1e-12):
            if damping > 1e12:
                break
            damping = max(10 * damping, 1e-6)
            continue
        a, b, own, damping = a + da, b + db, there, damping / 10 if damping > 1e-9 else 0.0
        if abs(da) <= tolerance * abs(a) and abs(db) <= tolerance * abs(b):
            break
    return spark.createDataFrame([(a, b)], schema)


def neighbours(states: DataFrame, elements: list[int], most: int) -> DataFrame:
    """states(graph, chain array<int>) -> (graph, kind, chain): each state that one move reaches: replace, add or remove an element."""
    chain, options = F.col("chain"), F.array(*map(F.lit, elements))
    at = lambda k, z: F.concat(F.slice(chain, 1, k), F.array(z), F.slice(chain, k + 2, F.size(chain)))
    replaced = F.flatten(F.transform(F.sequence(F.lit(0), F.size(chain) - 1), lambda k: F.transform(F.filter(options, lambda z: z != F.get(chain, k)), lambda z: at(k, z))))
    added = F.when(F.size(chain) < most, F.transform(options, lambda z: F.concat(chain, F.array(z))))
    removed = F.when(F.size(chain) > 1, F.array(F.slice(chain, 1, F.size(chain) - 1)))

    def named(kind: str, chains: Column) -> Column:
        return F.transform(F.coalesce(chains, F.array().cast("array<array<int>>")), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("chain")))

    moves = F.concat(named("replace", replaced), named("add", added), named("remove", removed))
    return states.filter(F.size("chain") > 0).select("graph", F.explode(moves).alias("m")).select("graph", "m.kind", "m.chain")


def crossings(couples: DataFrame, chains: DataFrame, bonds: DataFrame, most: int) -> DataFrame:
    """couples(left, right) of chains(graph, chain) -> (left, right, cut_left, cut_right, chain): the left one's front joined to the right one's end.

    Both are cut at bonds of one order, so the fragments fit; an equi-join on couple and order finds these.
    """
    cuts = bonds.select("graph", F.col("a").alias("cut"), "order")
    left = couples.join(cuts.toDF("left", "cut_left", "order"), "left").join(chains.toDF("left", "lc"), "left")
    right = couples.join(cuts.toDF("right", "cut_right", "order"), "right").join(chains.toDF("right", "rc"), "right")
    met = left.join(right, ["left", "right", "order"])
    child = F.concat(F.slice("lc", F.lit(1), F.col("cut_left")), F.slice("rc", F.col("cut_right") + 1, F.size("rc")))
    return met.select("left", "right", "cut_left", "cut_right", child.alias("chain")).filter(F.size("chain") <= most)


def angular_pairs(orbitals: DataFrame) -> DataFrame:
    """orbitals(id, ao, atom, l, c) -> (id, same, l1, l2, v): sums of c c' over pairs of atomic orbitals, by both angular momenta and
    whether they are of one atom. Sums by atom and momentum come first, so no pairs of orbitals are made."""
    by_atom = orbitals.groupBy("id", "atom", "l").agg(F.sum("c").alias("s"))
    a, b = by_atom.toDF("id", "a1", "l1", "s1"), by_atom.toDF("id", "a2", "l2", "s2")
    return a.join(b, "id").groupBy("id", (F.col("a1") == F.col("a2")).alias("same"), "l1", "l2").agg(F.sum(F.col("s1") * F.col("s2")).alias("v"))


def orbital_matrix(orbitals: DataFrame, weight: Column) -> DataFrame:
    """orbitals(id, orb, ao, c, ...) -> (id, a, b, v): C diag(weight) C', sums over orbitals of the weight times both coefficients.

    Weights of 1 give the inverse overlap's form, occupations the density, energies the Fock matrix, cos and sin of energies
    times a time the propagator.
    """
    rows = orbitals.select("id", "orb", "ao", "c", weight.alias("m"))
    left, right = rows.select("id", "orb", F.col("ao").alias("a"), (F.col("c") * F.col("m")).alias("x")), rows.select("id", "orb", F.col("ao").alias("b"), F.col("c").alias("y"))
    return left.join(right, ["id", "orb"]).groupBy("id", "a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("v"))


def orbital_couplings(orbitals: DataFrame, matrix: DataFrame) -> DataFrame:
    """orbitals(id, orb, ao, atom, l, c), matrix(id, a, b, v) -> (id, orb, same, l1, l2, v): sums of v c_a c_b by both angular
    momenta and whether both atomic orbitals are of one atom."""
    own = ["id", "orb"]
    left = orbitals.select(*own, F.col("ao").alias("a"), F.col("atom").alias("a1"), F.col("l").alias("l1"), F.col("c").alias("c1"))
    right = orbitals.select(*own, F.col("ao").alias("b"), F.col("atom").alias("a2"), F.col("l").alias("l2"), F.col("c").alias("c2"))
    met = left.join(matrix, ["id", "a"]).join(right, [*own, "b"])
    return met.groupBy(*own, (F.col("a1") == F.col("a2")).alias("same"), "l1", "l2").agg(F.sum(F.col("v") * F.col("c1") * F.col("c2")).alias("v"))


def orbital_energies(orbitals: DataFrame, matrix: DataFrame) -> DataFrame:
    """(id, orb, energy): c' F c of each orbital, by which energies inside its representation are shifted."""
    left = orbitals.select("id", "orb", F.col("ao").alias("a"), F.col("c").alias("c1")).join(matrix, ["id", "a"])
    met = left.join(orbitals.select("id", "orb", F.col("ao").alias("b"), F.col("c").alias("c2")), ["id", "orb", "b"])
    return met.groupBy("id", "orb").agg(F.sum(F.col("v") * F.col("c1") * F.col("c2")).alias("energy"))


def pseudo_orbitals(orbitals: DataFrame) -> DataFrame:
    """(id, atom, parts): what all occupied orbitals have at one atom, as one pseudo-orbital in the order of orbitals; those of graphs
    without any occupied one are kept as they are, a part each, with atom NULL."""
    some = F.max(F.col("occupied").cast("int")).over(Window.partitionBy("id"))
    rows = orbitals.withColumn("some", some).filter((F.col("some") == 0) | F.col("occupied"))
    atom = F.when(F.col("some") == 1, F.col("atom"))
    return rows.groupBy("id", atom.alias("atom")).agg(F.array_sort(F.collect_list(F.struct("orb", "ao", "c"))).alias("parts"))


def populations(orbitals: DataFrame) -> DataFrame:
    """(id, l, share): squares of coefficients by angular momentum, normalised."""
    by_l = orbitals.groupBy("id", "l").agg(F.sum(F.col("c") * F.col("c")).alias("p"))
    return by_l.select("id", "l", (F.col("p") / F.sum("p").over(Window.partitionBy("id"))).alias("share"))


def corners_of(points: np.ndarray) -> np.ndarray:
    """The corners of the convex hull of distinct points sorted by both coordinates: a lower and an upper chain."""

    def chain(rows: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for p in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out

    return np.unique(np.array(chain(points) + chain(points[::-1])), axis=0)


def convex_hull(points: DataFrame) -> DataFrame:
    """points(u, v) -> the corners of their convex hull. Each task leaves its own corners; one task takes those of all."""

    def corners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, 2))
        for batch in batches:
            held = np.unique(np.vstack([held, np.column_stack([batch["u"].to_numpy(), batch["v"].to_numpy()])]), axis=0)
            held = corners_of(held) if len(held) > 2 else held
        if len(held):
            yield pa.record_batch([pa.array(held[:, 0]), pa.array(held[:, 1])], ["u", "v"])

    some = points.filter("u IS NOT NULL AND v IS NOT NULL").select(F.col("u").cast("double").alias("u"), F.col("v").cast("double").alias("v"))
    return some.mapInArrow(corners, "u double, v double").repartition(1).mapInArrow(corners, "u double, v double")


def cluster_counts(vectors: DataFrame, counts: tuple[int, ...] = (2, 3, 4, 5), seed: int = 1) -> DataFrame:
    """(k, silhouette, best) of clusterings of vectors(id, x)."""
    rows, out = vectors.select(array_to_vector("x").alias("features")), []
    for k in counts:
        found = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(rows).transform(rows)
        out.append((k, float(ClusteringEvaluator(featuresCol="features", predictionCol="cluster").evaluate(found))))
    top = max(out, key=lambda r: (r[1], -r[0]))[0]
    return vectors.sparkSession.createDataFrame([(k, s, k == top) for k, s in out], "k int, silhouette double, best boolean")


def prefix_diversity(vectors: DataFrame, parts: int = 10) -> DataFrame:
    """(part, rows, diversity): the norm of the two greatest singular values of all rows up to the end of each range of ids.

    Ranges are equally wide. Tasks sum products of components by range, as small as the vectors are short; ranges' sums
    add up to prefixes.
    """
    ends = vectors.agg(F.min("id").alias("low"), F.max("id").alias("high")).first()
    if ends["low"] is None:
        return vectors.sparkSession.createDataFrame([], "part int, rows long, diversity double")
    part = F.floor((F.col("id") - ends["low"]) * parts / (ends["high"] - ends["low"] + 1)).cast("int")

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            own, x = batch["part"].to_numpy(), batch["x"]
            x = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)
            for k in np.unique(own):
                some = x[own == k]
                n, total = sums.get(int(k), (0, 0))
                sums[int(k)] = [n + len(some), total + some.T @ some]
        for k, (n, total) in sums.items():
            yield pa.record_batch([pa.array([k], pa.int32()), pa.array([n], pa.int64()), pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], ["part", "n", "sums"])

    summed = vectors.filter("x IS NOT NULL").select(part.alias("part"), "x").mapInArrow(products, "part int, n long, sums array<double>")
    counts = {r["part"]: r["n"] for r in summed.groupBy("part").agg(F.sum("n").alias("n")).collect()}
    cells = summed.select("part", F.posexplode("sums").alias("k", "v")).groupBy("part", "k").agg(F.sum("v").alias("v")).toArrow()
    p, k, v = (cells[c].to_numpy() for c in ("part", "k", "v"))
    size = int(np.sqrt(k.max(initial=-1) + 1))
    total, n, out = np.zeros(size * size), 0, []
    for at in sorted(counts):
        total[k[p == at]] += v[p == at]
        n += counts[at]
        top = np.linalg.eigvalsh(total.reshape(size, size))[-2:]
        out.append((int(at), int(n), float(np.sqrt(np.maximum(top, 0).sum()))))
    return vectors.sparkSession.createDataFrame(out, "part int, rows long, diversity double")
