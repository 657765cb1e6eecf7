"""Operators on molecules, orbitals, files, selections and searches against plain Python and NumPy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kerntrail.functions import scalars as S
from kerntrail.functions import vectors as V
from kerntrail.operators import canonical, exact, graphs, molecules, pairs, records, search, selection, trajectories
from kerntrail.operators import orbitals as O
from kerntrail.sources import text as X

ATOMS, BONDS = "graph long, atom int, z int", "graph long, a int, b int, `order` int"


def branched(spark):
    """Isobutane's shape with an oxygen and a doubly bonded one; dimethyl sulphide; three nitrogens with too many bonds; a lone atom."""
    atoms = [(1, 1, 6), (1, 2, 6), (1, 3, 8), (1, 4, 8), (2, 1, 6), (2, 2, 16), (2, 3, 6), (3, 1, 7), (3, 2, 7), (3, 3, 7), (4, 1, 6)]
    bonds = [(1, 1, 2, 1), (1, 2, 3, 1), (1, 2, 4, 2), (2, 1, 2, 1), (2, 2, 3, 1), (3, 1, 2, 2), (3, 2, 3, 2)]
    return spark.createDataFrame(atoms, ATOMS), spark.createDataFrame(bonds, BONDS)


def test_hydrogens(spark):
    atoms, bonds = branched(spark)
    filled = molecules.filled(atoms, bonds)
    got = {(r.graph, r.atom): (r.valence, r.hydrogens) for r in filled.collect()}
    assert [got[1, k] for k in (1, 2, 3, 4)] == [(4, 3), (4, 0), (2, 1), (2, 0)]
    assert got[2, 2] == (2, 0) and got[3, 2] == (None, None) and got[4, 1] == (4, 4)
    every, edges = molecules.with_hydrogens(filled, bonds)
    counts = {r.graph: (r.n, r.last) for r in every.groupBy("graph").agg(F.count(F.lit(1)).alias("n"), F.max("atom").alias("last")).collect()}
    assert counts == {1: (8, 8), 2: (9, 9), 3: (5, 5), 4: (5, 5)}
    own = {(r.a, r.b) for r in edges.filter("graph = 1 AND b > 4").collect()}
    assert own == {(1, 5), (1, 6), (1, 7), (3, 8)}
    assert {r.graph for r in molecules.unprotonated(filled, [8]).collect()} == {2, 3, 4}
    shape = {(r.graph, r.atom): (r.coordination, r.effective, r.hybridisation) for r in molecules.coordination(filled).collect()}
    assert shape[1, 1] == (4, 4, "sp3") and shape[1, 2] == (3, 3, "sp2") and shape[1, 3] == (2, 4, "sp3") and shape[1, 4] == (1, 3, "sp2") and shape[2, 2] == (2, 4, "sp3")
    assert {r.graph: (r.heavy, r.hydrogens, r.covalent) for r in molecules.totals(filled).collect()}[1] == (4, 4, 8)
    energy = molecules.hydrogenation(filled, spark.createDataFrame([(1, -10.0)], "graph long, energy double"), {6: -3.0, 8: -1.0}, -0.5).first().energy
    assert energy == pytest.approx(-10 + 2 * 3 + 2 * 1 - 0.5 * (2 * 4 + 2 * 2 - 4) / 2)


def plain_moves(atoms, bonds, elements):
    """All changes by loops over atoms, pairs and elements."""
    valences = {6: [4], 7: [3], 8: [2], 16: [2, 4, 6]}
    used, near, order = dict.fromkeys(atoms, 0), {a: [] for a in atoms}, {}
    for a, b, o in bonds:
        used[a] += o
        used[b] += o
        near[a].append(b)
        near[b].append(a)
        order[a, b] = order[b, a] = o
    v = {a: min((k for k in valences[z] if k >= used[a]), default=None) for a, z in atoms.items()}
    h = {a: 0 if v[a] is None else v[a] - used[a] for a in atoms}
    for a, z in atoms.items():
        up = min((k for k in valences[z] if v[a] is not None and k > v[a]), default=None)
        down = max((k for k in valences[z] if v[a] is not None and k < v[a]), default=None)
        if h[a] > 0:
            yield from (("add", a, None, e) for e in elements)
        if len(near[a]) == 1:
            yield "remove", a, None, z
        yield from (("replace", a, None, e) for e in elements if e != z and max(valences[e]) >= used[a])
        if up is not None:
            yield "valence", a, None, up
            yield from (("valence_add", a, None, e) for e in elements if max(valences[e]) >= up - v[a])
            yield from (("valence_bond", a, b, up) for b in near[a] if h[b] >= up - v[a] and order[a, b] + up - v[a] <= 3)
        if down is not None:
            if h[a] >= v[a] - down:
                yield "valence", a, None, down
            yield from (("valence_remove", a, b, down) for b in near[a] if len(near[b]) == 1 and order[a, b] == v[a] - down)
        for b in atoms:
            if a < b and h[a] > 0 and h[b] > 0 and order.get((a, b), 0) < 3:
                yield "bond", a, b, order.get((a, b), 0) + 1
            if a < b and order.get((a, b), 0) > 1:
                yield "bond", a, b, order[a, b] - 1


def test_moves_of_branched_graphs(spark):
    atoms = [(1, 1, 6), (1, 2, 6), (1, 3, 8), (1, 4, 8), (1, 5, 7), (2, 1, 8), (2, 2, 16), (2, 3, 8), (2, 4, 6), (3, 1, 16), (3, 2, 6), (3, 3, 16), (4, 1, 16), (5, 1, 16), (5, 2, 8), (5, 3, 6), (5, 4, 6)]
    bonds = [(1, 1, 2, 1), (1, 2, 3, 1), (1, 2, 4, 2), (1, 1, 5, 1), (2, 1, 2, 2), (2, 2, 3, 1), (2, 2, 4, 1), (3, 1, 2, 1), (3, 2, 3, 2), (5, 1, 2, 2), (5, 1, 3, 1), (5, 1, 4, 1)]
    frame, edges = spark.createDataFrame(atoms, ATOMS), spark.createDataFrame(bonds, BONDS)
    got = sorted(map(str, map(tuple, molecules.moves(molecules.filled(frame, edges), edges, [6, 7, 16]).collect())))
    want = []
    for g in range(1, 6):
        want += [(g, *m) for m in plain_moves({a: z for k, a, z in atoms if k == g}, [b[1:] for b in bonds if b[0] == g], [6, 7, 16])]
    assert got == sorted(map(str, want)) and {m[1] for m in want} == {"add", "remove", "replace", "bond", "valence", "valence_add", "valence_remove", "valence_bond"}


def test_unique_carbonised_and_shuffled_graphs(spark):
    chain = lambda g, zs: [(g, k + 1, z) for k, z in enumerate(zs)]
    kinds = {1: [6, 6], 2: [6, 6, 6], 3: [6, 6], 4: [8, 6, 6, 6], 5: [6, 6, 6, 8], 6: [6, 8], 7: [7, 6, 6, 6], 8: [8, 6, 8, 6]}
    atoms = spark.createDataFrame([x for g, zs in kinds.items() for x in chain(g, zs)], ATOMS)
    bonds = spark.createDataFrame([(g, k, k + 1, 1) for g, zs in kinds.items() for k in range(1, len(zs))], BONDS)
    assert {r.graph: r.copies for r in molecules.unique(atoms, bonds).collect()} == {1: 2, 2: 1, 4: 2, 6: 1, 7: 1, 8: 1}
    # 6 is like a chain of two carbons; of those like four only the first stays
    assert {r.graph: r.tier for r in molecules.carbonised_unique(atoms, bonds).collect()} == {1: 0, 2: 0, 4: 1}
    keys = {r.graph: r.key for r in canonical.graph_keys(atoms, bonds).collect()}
    other = molecules.shuffled(atoms, bonds, 7)
    assert keys == {r.graph: r.key for r in canonical.graph_keys(*other).collect()}
    assert other[0].join(atoms, ["graph", "atom", "z"], "left_anti").count() > 0


def test_pair_classes_of_a_star(spark):
    atoms = spark.createDataFrame([(1, 1, 6), (1, 2, 8), (1, 3, 8), (1, 4, 8)], ATOMS)
    bonds = spark.createDataFrame([(1, 1, 2, 1), (1, 1, 3, 1), (1, 1, 4, 1)], BONDS)
    got = {(r.class_a, r.class_b, r.d): r.pairs for r in molecules.pair_classes(atoms, bonds).collect()}
    assert got == {(1, 2, 1.0): 3, (2, 1, 1.0): 3, (2, 2, 2.0): 6}


def test_matching_fragments_count_pairings(spark):
    fragments = spark.createDataFrame([(1, [1, 2, 1]), (2, [2, 1, 1]), (3, [1, 1]), (4, []), (5, [2, 2, 2, 1])], "id long, orders array<int>")
    couples = spark.createDataFrame([(1, 2), (1, 3), (4, 4), (5, 5)], "left long, right long")
    assert {(r.left, r.right): r.ways for r in molecules.matching_fragments(couples, fragments).collect()} == {(1, 2): 2, (5, 5): 6}


def test_scalars(spark):
    c = F.lit
    row = spark.range(1).select(
        S.element_case(c("cL")).alias("cl"), S.any_of(F.array(c("a"), c(None)), ["b", "a"]).alias("yes"), S.any_of(F.array().cast("array<string>"), ["a"]).alias("no"),
        S.repeated(["x", "y"], c(3)).alias("map"), S.nonzero(F.array(c(0.0), c(2.0), c(0.0))).alias("nz"), S.square_form(F.array(c(1.0), c(2.0), c(3.0)), c(3)).alias("m"),
        S.next_valence(c(16), c(2)).alias("up"), S.next_valence(c(6), c(4)).alias("none"), S.least_valence(c(15), c(4)).alias("least"), S.in_interval(c(4), [(0, 2), (3, 5)]).alias("k"),
        S.in_interval(c(9), [(0, 2), (3, 5)]).alias("out"), S.powered(c(2.0), c(3.0), 2, 0, 5).alias("p"), S.powered(c(7.0), c(3.0), 2, 0, 5).alias("above"), S.unshared_pairs(c(8), c(2)).alias("pairs"),
        S.log_share(c(0), c(5)).alias("nolog"), S.diatomic_barrier(c(6), c(8), c(2), 8).alias("barrier"), S.order_slide(F.array(c(8), c(6), c(7)), [8, 6, 7]).alias("slide"),
    ).first()
    assert (row.cl, row.yes, row.no, row.map, row.nz) == ("Cl", True, False, {"x": 3, "y": 3}, [2.0])
    assert row.m == [[0.0, 1.0, 2.0], [1.0, 0.0, 3.0], [2.0, 3.0, 0.0]] and (row.up, row.none, row.least) == (4, None, 5)
    assert (row.k, row.out, row.p, row.above, row.pairs, row.nolog, row.barrier, row.slide) == (1, None, 18.0, None, 2, None, 3, -3)
    betas = S.exponential_betas(2.0, 5, 1.7)
    assert betas[-1] == pytest.approx(2.0) and betas[-2] / betas[-1] == pytest.approx(1.7)
    b = betas[0] / betas[1] - 1  # c / (b^k - 1)
    assert all(betas[0] * (b - 1) / (b ** (k + 1) - 1) == pytest.approx(v) for k, v in enumerate(betas))


def test_files_labels_and_tables(spark, tmp_path):
    body = "2\ngdb {n} 1 2 3 4 5 6 7 8 9 1.0 -4*^1 12 13 14 15\nC 0 0 0 0.1\nO 0 0 1.2*^0 0.2\n100.0 200.0\n{s}\tOC\nInChI=1S/x\tInChI=y\n"
    for name, n, s in (("b.xyz", 2, "CO"), ("a.xyz", 1, "CO"), ("c.xyz", 3, "C=O")):
        (tmp_path / name).write_text(body.format(n=n, s=s))
    assert [r.path.rsplit("/", 1)[1] for r in X.list_files(spark, str(tmp_path)).collect()] == ["a.xyz", "b.xyz", "c.xyz"]
    rows = {r.path.rsplit("/", 1)[1]: r for r in X.molecule_table(spark, str(tmp_path), {"C": -30.0, "O": -8.0}).collect()}
    assert set(rows) == {"a.xyz", "c.xyz"} and rows["a.xyz"].U0 == -40.0 and rows["a.xyz"].atomisation == -2.0 and rows["c.xyz"].representation == "C=O"
    inchi = X.read_xyz(spark, str(tmp_path)).select(X.line_token(F.struct("rest"), 2).alias("i"), X.line_token(F.struct("rest"), 9).alias("none")).first()
    assert (inchi.i, inchi.none) == ("InChI=1S/x", None)
    labels = spark.createDataFrame([("0 C 2px",), ("12O 3dxy",), ("1 H 1s",)], "t string").select(X.orbital_label(F.col("t")).alias("l")).select("l.*").collect()
    assert [tuple(r) for r in labels] == [(0, "2p", 1, "x"), (12, "3d", 2, "xy"), (1, "1s", 0, "")]
    word = spark.range(1).select(X.state_word(F.lit("C:16,V:4,H:2")).alias("w"), X.state_word(F.lit("C:6")).alias("v")).first()
    assert tuple(word.w) == (16, 4, 2) and tuple(word.v) == (6, None, None)
    values = spark.createDataFrame([("a", 1.5), ("b", -2.0)], "id string, value double")
    X.write_values(values, str(tmp_path / "values"))
    assert sorted(map(tuple, X.read_values(spark, str(tmp_path / "values")).collect())) == [("a", 1.5), ("b", -2.0)]
    log = spark.createDataFrame([(0, 1, "a"), (1, 1, "b")], "replica long, step long, key string")
    trajectories.save(log, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2


def test_orbital_matrices_equal_numpy(spark):
    rng = np.random.default_rng(1)
    c = rng.normal(size=(3, 4))  # orbitals x atomic orbitals
    rows = [(1, o, a, a // 2, a % 2, float(c[o, a]), o == 0) for o in range(3) for a in range(4)]
    frame = spark.createDataFrame(rows, "id int, orb int, ao int, atom int, l int, c double, occupied boolean")
    energies = np.array([1.0, 2.0, 3.0])
    matrix = records.orbital_matrix(frame, F.col("orb") + 1.0)
    want = c.T @ np.diag(energies) @ c
    assert all(abs(r.v - want[r.a, r.b]) < 1e-12 for r in matrix.collect()) and matrix.count() == 16
    for r in records.orbital_energies(frame, matrix).collect():
        assert r.energy == pytest.approx(c[r.orb] @ want @ c[r.orb])
    couplings = {(r.orb, r.same, r.l1, r.l2): r.v for r in records.orbital_couplings(frame, matrix).collect()}
    for (o, same, l1, l2), v in couplings.items():
        assert v == pytest.approx(sum(want[a, b] * c[o, a] * c[o, b] for a in range(4) for b in range(4) if (a // 2 == b // 2) == same and a % 2 == l1 and b % 2 == l2))
    assert len(couplings) == 24 - 3 * 0 and {r.atom: len(r.parts) for r in records.pseudo_orbitals(frame).collect()} == {0: 2, 1: 2}
    nobody = records.pseudo_orbitals(frame.withColumn("occupied", F.lit(False))).collect()
    assert [(r.atom, len(r.parts)) for r in nobody] == [(None, 12)]


def test_nested_kernel_slope(spark):
    rng = np.random.default_rng(2)
    data = [(m, p, 1.0, [(float(rng.uniform(0.5, 1)), [float(v) for v in rng.normal(size=2)]) for _ in range(2)]) for m in range(3) for p in range(2)]
    parts = spark.createDataFrame(data, "id int, part int, rho double, comps array<struct<rho:double,v:array<double>>>")
    of = lambda s: {(r.i, r.j): r.k for r in O.molecule_kernel(parts, s, 1).collect()}
    low, high = of(1.0 - 1e-5), of(1.0 + 1e-5)
    for r in O.molecule_kernel(parts, 1.0, 1, slope=True).collect():
        assert r.dk == pytest.approx((high[r.i, r.j] - low[r.i, r.j]) / 2e-5, abs=1e-6)


def test_error_gradients_equal_differences(spark):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(40, 3)), rng.normal(size=40)
    own = np.arange(40) % 2 == 0
    for name in pairs.KERNELS:
        at = lambda s, r, name=name: search.errors(x, y, own, name, s, r)
        found = at(1.3, 0.2)
        by_s, by_r = (at(1.3 + 1e-6, 0.2) - at(1.3 - 1e-6, 0.2)) / 2e-6, (at(1.3, 0.2 + 1e-6) - at(1.3, 0.2 - 1e-6)) / 2e-6
        assert np.allclose(found[[2, 4]], by_s[:2], atol=1e-5) and np.allclose(found[[3, 5]], by_r[:2], atol=1e-5)
    assert search.errors(np.zeros((4, 1)), y[:4], np.array([True, True, True, False]), "gaussian", 1.0, 0.0) is None


def test_searches_find_a_minimum():
    bowl = lambda v: ((math.log(v[0]) - 1) ** 2 + 2 * (math.log(v[1]) + 2) ** 2, np.array([2 * (math.log(v[0]) - 1) / v[0], 4 * (math.log(v[1]) + 2) / v[1]]))
    log = search.noisy_descent(bowl, np.zeros(2), 60)
    errors = [e for _, _, e, taken in log if taken]
    assert errors == sorted(errors, reverse=True) and errors[-1] < 0.2
    last = [row for row in search.quasi_newton(bowl, np.zeros(2), 20) if row[3]][-1]
    assert last[2] < 1e-6 and np.allclose(last[1], [1, -2], atol=1e-2)
    nowhere = lambda v: (None, np.zeros(2))
    assert not any(taken for step, _, _, taken in search.noisy_descent(nowhere, np.zeros(2), 3) if step)


def test_gradient_search_improves(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(120, 2))
    rows = spark.createDataFrame([(i, a.tolist(), [float(np.sin(2 * a[0]) + a[1])]) for i, a in enumerate(x)], "id long, x array<double>, y array<double>")
    for reduce in (search.logarithms, search.shared_logarithm(0.01)):
        found = search.gradient_search(rows, steps=5, refine=3, folds=4, sigma=6.0, ridge=0.06, reduce=reduce).toPandas()
        assert found.error.min() < found.error.iloc[0] and found.accepted.iloc[0]
    model = exact.fit(rows, lambda train: 2.0, 1e-3)
    assert model["sigma"] == 2.0 and exact.fit(rows)["sigma"] == pytest.approx(np.abs(x[:, None] - x).sum(-1).max())


def test_pivoted_rows_equal_a_loop(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 5)) @ np.diag([5, 3, 2, 1, 0.1])
    x[7], x[8] = 0, x[3] * 2
    want, rest = [], x.copy()
    for _ in range(6):
        square = (x * x).sum(1)
        share = np.where(square > 0, (rest * rest).sum(1) / np.where(square > 0, square, 1), 0)
        k = min(range(60), key=lambda i: (-round(share[i], 12), i))
        if share[k] <= 1e-9:
            break
        want.append(k)
        u = rest[k] / np.linalg.norm(rest[k])
        rest = rest - np.outer(rest @ u, u)
    frame = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, x array<double>")
    found = [r.id for r in selection.pivoted(frame, 6).orderBy("place").collect()]
    assert len(found) == len(want) == 5 and set(found[:1]) <= set(range(60)) and np.linalg.matrix_rank(x[found]) == 5
    assert found[1:] == want[1:] or found == want


def test_principal_components_equal_numpy(spark):
    x = np.random.default_rng(6).normal(size=(80, 6)) @ np.diag([4, 3, 2, 1, 1, 1])
    frame = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, x array<double>")
    _, _, v = np.linalg.svd(x - x.mean(axis=0))
    want = np.abs((x - x.mean(axis=0)) @ v[:2].T)
    assert all(np.allclose(np.abs(r.p), want[r.id], atol=1e-6) for r in selection.projected(frame).collect())


def test_clusters(spark):
    rng = np.random.default_rng(7)
    centres = np.array([[0, 0], [20, 0], [0, 20]])
    x = centres[np.arange(90) % 3] + rng.normal(size=(90, 2))
    frame = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, x array<double>")
    got = sorted(r.id for r in selection.representatives(frame, 3).collect())
    mean = [x[np.arange(90) % 3 == k].mean(axis=0) for k in range(3)]
    assert got == sorted(min((k for k in range(90) if k % 3 == c), key=lambda k: ((x[k] - mean[c]) ** 2).sum()) for c in range(3))
    counts = {r.k: (r.silhouette, r.best) for r in records.cluster_counts(frame).collect()}
    assert [k for k, (_, best) in counts.items() if best] == [3]
    d = ((x[:, None] - x) ** 2).sum(-1)
    own = np.arange(90) % 3
    score = []
    for i in range(90):
        a = d[i][own == own[i]].sum() / 29
        b = min(d[i][own == c].mean() for c in range(3) if c != own[i])
        score.append((b - a) / max(a, b))
    assert counts[3][0] == pytest.approx(np.mean(score), abs=1e-6)


def test_renumbered_and_complete_rows(spark):
    rows = spark.createDataFrame([(i * 3, None if i % 4 == 0 else float("nan") if i % 4 == 1 else float(i)) for i in range(40)], "id long, v double").repartition(5)
    found = records.renumbered(records.complete(rows, "v"), "id", "place").orderBy("id").collect()
    assert [r.place for r in found] == list(range(20)) and [r.id for r in found] == [i * 3 for i in range(40) if i % 4 > 1]
    assert records.without(rows, rows.filter("id < 30")).count() == 30
    assert V.sphere_volume(1, 0.5) == pytest.approx(1.0)
