"""Operators against NumPy, on small made-up rows with the awkward cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kerntrail.functions import vectors as V
from kerntrail.operators import canonical, exact, graphs, pairs, ridge, selection, trajectories, weights
from kerntrail.sources import text as X
from kerntrail.streaming import visits


def vectors(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, x array<double>")


def test_kernels_by_name(spark):
    x = np.random.default_rng(1).normal(size=(30, 4))
    for name in pairs.KERNELS:
        got = {(r.i, r.j): r.k for r in pairs.kernel_entries(vectors(spark, x), name, 1.3, blocks=3, ridge=0.5).collect()}
        want = pairs.kernel_block(x, x, name, 1.3) + 0.5 * np.eye(30)
        assert len(got) == 30 * 31 // 2
        assert all(abs(want[i, j] - k) < 1e-12 for (i, j), k in got.items())


def test_within_deals_unit_vectors_to_many_tasks(spark):
    x = np.random.default_rng(12).normal(size=(600, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    v = vectors(spark, x)
    found = pairs.within(v.toDF("i", "a"), v.toDF("j", "b"), 1.2, 0.3, block=64)
    d = np.sqrt(((x[:, None] - x) ** 2).sum(-1))
    assert {(r.i, r.j) for r in found.collect()} == set(zip(*(k.tolist() for k in np.nonzero((d >= 0.3) & (d <= 1.2))), strict=True))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert found.withColumn("task", F.spark_partition_id()).select("task").distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert pairs.within(v.limit(0).toDF("i", "a"), v.limit(0).toDF("j", "b"), 1.0).count() == 0


def test_nearest_takes_the_smaller_id_of_equal_rows(spark):
    x = np.random.default_rng(11).normal(size=(300, 8))
    x[200:] = x[:100]
    d = ((x[:, None] - x) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    got = {(r.id, r["rank"]): (r.neighbour, r.d2) for r in pairs.nearest_k(vectors(spark, x), 3, blocks=3).collect()}
    for i in range(300):
        want = sorted((v, j) for j, v in enumerate(d[i]))[:3]
        assert [got[i, k + 1][0] for k in range(3)] == [j for _, j in want] and all(abs(got[i, k + 1][1] - v) < 1e-9 for k, (v, _) in enumerate(want))


def test_within_finds_all_pairs(spark):
    x = np.random.default_rng(2).normal(size=(60, 3)) * 2
    v = vectors(spark, x)
    got = {(r.i, r.j) for r in pairs.within(v.toDF("i", "a"), v.toDF("j", "b"), 1.5, 0.5).collect()}
    d = np.sqrt(((x[:, None] - x) ** 2).sum(-1))
    assert got == {(i, j) for i in range(60) for j in range(60) if 0.5 <= d[i, j] <= 1.5}


def test_regression_is_exact_when_all_rows_are_landmarks(spark):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(40, 3)), rng.normal(size=40)
    rows = vectors(spark, x).withColumn("y", F.array(*[F.element_at(F.array(*map(F.lit, y.tolist())), (F.col("id") + 1).cast("int"))]))
    model = ridge.fit(rows, 1.5, 0.1, most=100)
    got = {r.id: r.prediction[0][0] for r in ridge.predict(rows, model, ["id"]).collect()}
    k = pairs.kernel_block(x, x, "gaussian", 1.5)
    # the constant takes the place of the mean: bordered system
    a = np.block([[k + 0.1 * np.eye(40), np.ones((40, 1))], [np.ones((1, 40)), np.zeros((1, 1))]])
    s = np.linalg.solve(a, np.append(y, 0))
    assert all(abs(got[i] - (k[i] @ s[:-1] + s[-1])) < 1e-4 for i in range(40))


def test_regression_on_all_rows_equals_numpy(spark, tmp_path):
    rng = np.random.default_rng(13)
    x = rng.normal(size=(1000, 5))
    y = np.column_stack([x[:, 0] + x[:, 1] ** 2, x[:, 2], 7 * x[:, 3]])
    gap = np.arange(1000) % 3 == 0
    data = [(i, a.tolist(), [float(b[0]), None if gap[i] else float(b[1]), float(b[2])]) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    rows = spark.createDataFrame(data, "id long, x array<double>, y array<double>")
    for options in ({"block": 400}, {"block": 2048, "scale": True}):
        got = {r.id: r.prediction for r in exact.predict(rows, exact.fit(rows, 1.5, 1e-2, **options)).collect()}
        exact.save(exact.fit(rows, 1.5, 1e-2, **options), str(tmp_path / "model"))
        again = {r.id: r.prediction for r in exact.predict(rows, exact.load(spark, str(tmp_path / "model"))).collect()}
        assert all(np.allclose(got[i], again[i]) for i in got)
        k = pairs.kernel_block(x, x, "gaussian", 1.5)
        for q, own in ((0, gap | True), (1, ~gap), (2, gap | True)):
            c = np.linalg.solve(k[np.ix_(own, own)] + 1e-2 * np.eye(own.sum()), y[own, q] - y[own, q].mean())
            assert all(abs(got[i][q] - v) < 1e-8 for i, v in enumerate(k[:, own] @ c + y[own, q].mean()))


def test_learning_curve_falls_and_subsets_are_disjoint(spark):
    rng = np.random.default_rng(14)
    x = rng.normal(size=(900, 3))
    rows = spark.createDataFrame([(i, a.tolist(), [float(a[0] + a[1] ** 2)]) for i, a in enumerate(x)], "id long, x array<double>, y array<double>")
    found = exact.learning_curve(rows.filter("id >= 100"), rows.filter("id < 100"), [40, 160], 1.5, 1e-3).toPandas()
    assert found.groupby("size").size().to_dict() == {40: 4, 160: 4}
    errors = found.groupby("size")["mae"].mean()
    assert errors[160] < errors[40]
    drawn = exact.subset_of(rows, [40, 160], 4, 900)
    assert drawn.groupBy("size", "id").count().filter("count > 1").count() == 0


def test_orthonormal_solve():
    rng = np.random.default_rng(15)
    a = rng.normal(size=(20, 20))
    y = rng.normal(size=20)
    assert np.allclose(exact.orthonormal_solve(a @ a.T, y), np.linalg.solve(a @ a.T, y), atol=1e-6)
    b = rng.normal(size=(30, 6))
    k = b @ b.T  # singular: any solution's values at the rows are the labels
    y = k @ rng.normal(size=30)
    assert np.allclose(k @ exact.dense_solve(k, y), y, atol=1e-6) and np.allclose(k @ exact.orthonormal_solve(k, y), y, atol=1e-6)


def test_regression_leaves_out_missing_labels(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(30, 2))
    rows = vectors(spark, x).withColumn("y", F.array(F.when(F.col("id") % 2 == 0, F.col("x")[0]), F.col("x")[1]))
    one = rows.filter("id % 2 = 0").withColumn("y", F.array(F.col("x")[0]))
    marks = ridge.landmarks(rows)
    both = ridge.normal_equations(rows.withColumn("bucket", F.lit(0)), marks, "gaussian", 1.0)[0]
    alone = ridge.normal_equations(one.withColumn("bucket", F.lit(0)), marks, "gaussian", 1.0)[0]
    assert np.allclose(both[0][0], alone[0][0]) and np.allclose(both[1][0], alone[1][0])


def test_prune_nearest_equals_the_greedy_loop(spark):
    x = np.random.default_rng(5).normal(size=(50, 2))
    d = np.sqrt(((x[:, None] - x) ** 2).sum(-1))
    kept = set(range(50))
    for _, i, j in sorted((d[i, j], i, j) for i in range(50) for j in range(i + 1, 50) if d[i, j] <= 0.7):
        if i in kept and j in kept:
            kept.discard(j)
    got = {r.id for r in selection.prune_nearest(vectors(spark, x), 0.7).collect() if r.kept}
    assert got == kept
    few, order = set(range(50)), sorted((d[i, j], i, j) for i in range(50) for j in range(i + 1, 50) if d[i, j] <= 0.7)
    for _, i, j in order:
        if i in few and j in few and len(few) > 44:
            few.discard(j)
    assert {r.id for r in selection.prune_nearest(vectors(spark, x), 0.7, 44).collect() if r.kept} == few and len(kept) < 44


def test_prune_nearest_without_pairs(spark):
    assert selection.prune_nearest(vectors(spark, [[0.0], [9.0]]), 1.0).filter("kept").count() == 2


def test_linear_independence(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(4, 6))
    x = np.vstack([base[:2], base[0] * 2, np.zeros(6), base[2:], rng.normal(size=(20, 4)) @ base])
    got = sorted(r.id for r in selection.linear_independence(vectors(spark, x)).collect() if r.kept)
    assert got == [0, 1, 4, 5]


def test_skyline_with_ties(spark):
    p = spark.createDataFrame([(1, 1.0, 5.0), (2, 2.0, 5.0), (3, 2.0, 5.0), (4, 3.0, 1.0), (5, 3.0, 0.0), (6, 0.0, 4.0)], "id long, u double, v double")
    assert sorted(r.id for r in selection.skyline(p).collect()) == [2, 3, 4]


def test_cut_minor_equals_the_loop(spark):
    rng = np.random.default_rng(7)
    rows, want = [], {}
    for g in range(40):
        rho = rng.integers(1, 20, size=int(rng.integers(1, 8))).astype(float)
        rows += [(g, i, float(v)) for i, v in enumerate(rho)]
        order = sorted(range(len(rho)), key=lambda i: (-rho[i], i))
        s = [rho[i] / rho.sum() for i in order]
        if len(s) > 1:
            dropped, n = 0.0, len(s)
            while s[n - 1] * n + dropped <= 0.25:
                dropped += s[n - 1]
                n -= 1
            cut = (0.25 - dropped) / n
            s = [max(0.0, v - cut) for v in s[:n]]
        want |= {(g, i): v / sum(s) for i, v in zip(order, s, strict=False) if v > 1e-9}
    got = weights.cut_minor(spark.createDataFrame(rows, "g int, i int, rho double"), ["g"], ["i"], "rho", 0.75).collect()
    got = {(r.g, r.i): r.kept for r in got if r.kept > 1e-9}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_forward_fill_keeps_null_before_the_first_visit(spark):
    v = spark.createDataFrame([(0, 1, "a"), (0, 3, "b"), (1, 2, "c")], "replica long, step long, key string")
    got = {(r.replica, r.step): r.key for r in trajectories.forward_filled(v, F.lit(0).cast("long")).collect()}
    assert got == {(0, 0): None, (0, 1): "a", (0, 2): "a", (0, 3): "b", (1, 0): None, (1, 1): None, (1, 2): "c", (1, 3): "c"}


def test_candidates_leave_out_null_values(spark):
    v = spark.createDataFrame([("a", None), ("b", 2.0), ("b", 1.0), ("c", 1.0), ("d", 5.0)], "key string, f double")
    assert [tuple(r) for r in trajectories.best_candidates(v, 2).collect()] == [("b", 1.0), ("c", 1.0)]


def ring(spark, n, order):
    atoms = [(0, order[k], 6 if k % 2 else 7) for k in range(n)]
    bonds = [(0, *sorted((order[k], order[(k + 1) % n])), 1) for k in range(n)]
    return spark.createDataFrame(atoms, "graph long, atom int, z int"), spark.createDataFrame(bonds, "graph long, a int, b int, `order` int")


def test_graph_keys_ignore_numbering(spark):
    keys = {canonical.graph_keys(*ring(spark, 6, order)).first().key for order in ([1, 2, 3, 4, 5, 6], [4, 1, 6, 2, 5, 3])}
    assert len(keys) == 1
    chain = spark.createDataFrame([(0, k, k + 1, 1) for k in range(1, 6)], "graph long, a int, b int, `order` int")
    assert canonical.graph_keys(ring(spark, 6, [1, 2, 3, 4, 5, 6])[0], chain).first().key not in keys


def test_distances_and_components_of_a_ring_and_a_lone_atom(spark):
    atoms, bonds = ring(spark, 5, [1, 2, 3, 4, 5])
    atoms = atoms.union(spark.createDataFrame([(0, 9, 8)], atoms.schema))
    got = {(r.a, r.b): r.d for r in graphs.distances(atoms, bonds).collect()}
    assert got[1, 3] == 2 and got[1, 4] == 2 and got[9, 9] == 0 and (1, 9) not in got
    assert {r.atom: r.component for r in graphs.components(atoms, bonds).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 9: 9}


def test_great_graphs_go_through_joins_with_the_same_results(spark):
    atoms, bonds = ring(spark, 7, [3, 1, 4, 2, 6, 7, 5])
    atoms = atoms.union(spark.createDataFrame([(0, 9, 8), (1, 1, 6), (1, 2, 7)], atoms.schema))
    bonds = bonds.union(spark.createDataFrame([(1, 1, 2, 1)], bonds.schema))
    radii = {6: 0.76, 7: 0.71, 8: 0.66}
    for f in (lambda m: graphs.distances(atoms, bonds, radii, m), lambda m: graphs.distances(atoms, bonds, None, m), lambda m: graphs.components(atoms, bonds, m)):
        whole, joined = ({tuple(round(v, 6) for v in r) for r in f(m).collect()} for m in (256, 2))
        assert whole == joined and whole
    classes = [sorted({tuple(sorted(r.atom for r in rows if r.colour == c)) for c in {r.colour for r in rows}}) for rows in (graphs.refined(atoms.filter("graph = 0"), bonds, m).collect() for m in (256, 2))]
    assert classes[0] == classes[1]
    assert graphs.distances(atoms.limit(0), bonds.limit(0)).count() == 0


def test_xyz_files(spark, tmp_path):
    (tmp_path / "a.xyz").write_text("2\ncharge=1 flag name=x\nH 0.0 0.0 1.5*^-3\nO 1 x 2\n100.0 250.5\nCO\n")
    (tmp_path / "b.txt").write_text("no")
    row = X.read_xyz(spark, str(tmp_path)).select("natoms", "atoms", X.key_values(F.col("comment")).alias("m"), X.greatest_of_first_numbers(F.col("rest")).alias("top")).first()
    assert row.natoms == 2 and row.atoms[0].z == 0.0015 and row.atoms[1].y is None and row.m == {"charge": "1", "name": "x"} and row.top == 250.5


def test_property_lines_and_named_values(spark):
    row = spark.createDataFrame([("3\ngdb 17 1.5 2*^2 x\nE : -4.5\n",)], "t string").select(*X.property_line(F.col("t"), "gdb", {"p": 3, "q": 4, "bad": 5}), X.named_value(F.col("t"), "E").alias("e"), X.named_value(F.col("t"), "F").alias("none")).first()
    assert (row.p, row.q, row.bad, row.e, row.none) == (1.5, 200.0, None, -4.5, None)


def test_join_files_fails_without_exactly_one_file(spark):
    values = spark.createDataFrame([("1", 2.0)], "id string, v double")
    files = spark.createDataFrame([("/x/1__a.xyz", "t")], "path string, text string")
    assert X.join_files(values, files).count() == 1
    with pytest.raises(Exception, match="not one file"):
        X.join_files(values, files.union(files)).collect()


def test_graph_strings(spark):
    row = spark.createDataFrame([("7@1@2:6@3@4:6#1@3:6#1:6#3",)], "s string").select(X.parse_graph(F.col("s")).alias("g"))
    again = row.select(X.graph_text(F.col("g.atoms"), F.col("g.bonds")).alias("s"), F.size("g.bonds").alias("n")).first()
    assert again.s == "7@1@2:6@3@4:6#1@3:6#1:6#3" and again.n == 5


def test_potentials_and_ladders(spark):
    row = spark.range(1).select(V.lennard_jones(F.lit(2.0 ** (1 / 6)), 3.0, 1.0).alias("lj"), V.double_well(F.lit(1.3), 2.0, 2.0, 0.7).alias("dw"), V.upper_triangle(F.array(F.array(F.lit(1), F.lit(2)), F.array(F.lit(3), F.lit(4)))).alias("u")).first()
    assert abs(row.lj + 3) < 1e-9 and abs(row.dw + 2) < 1e-9 and row.u == [1, 2, 4]
    assert V.geometric_betas(1.0, 8.0, 4) == pytest.approx([1, 2, 4, 8]) and V.even_temperatures(1.0, 0.25, 4) == pytest.approx([1, 1 / 2, 1 / 3, 1 / 4])
    assert V.sphere_volume(3, 2.0) == pytest.approx(4 / 3 * np.pi * 8)


def test_stream_drops_rows_behind_the_watermark(spark, tmp_path):
    rows = "SELECT timestamp '{}' AS ts, '{}' AS key, 1.0D AS f"
    folder = str(tmp_path / "out")

    def add(*values):
        spark.sql(" UNION ALL ".join(rows.format(t, k) for t, k in values)).coalesce(1).write.mode("append").parquet(str(tmp_path / "t"))

    def run():
        stream = spark.readStream.schema("ts timestamp, key string, f double").parquet(str(tmp_path / "t"))
        got = visits.run_once(spark, visits.windowed_counts(stream, "ts", "1 hour", "10 minutes"), "w", ["start", "key"], folder).collect()
        return {(r.start.day, r.start.hour, r.key): r.visits for r in got}

    add(("2024-01-01 00:00:01", "a"), ("2024-01-02 00:30:00", "a"))
    assert run() == {(1, 0, "a"): 1, (2, 0, "a"): 1}
    # behind the watermark of 00:20 on the second day; within it; new
    add(("2024-01-01 00:10:00", "a"), ("2024-01-02 00:25:00", "a"), ("2024-01-02 03:00:00", "b"))
    assert run() == {(1, 0, "a"): 1, (2, 0, "a"): 2, (2, 3, "b"): 1}


def test_archives_and_bond_orders(spark, tmp_path):
    import tarfile

    (tmp_path / "w.txt").write_text("1 2 1.4\n2 1 1.4\n3 1 0.2\n2 3 1.9\nbad line\n")
    with tarfile.open(tmp_path / "a.tar.gz", "w:gz") as archive:
        archive.add(tmp_path / "w.txt", "in/w.txt")
    row = X.read_archives(spark, str(tmp_path)).select("member", X.bond_orders(F.col("text")).alias("b")).first()
    assert row.member == "in/w.txt" and [tuple(b) for b in row.b] == [(1, 2, 1), (2, 3, 2)]


def test_averaged_bonds(spark):
    rows = spark.createDataFrame([(1, 0, 1, 2, 1), (1, 1, 1, 2, 2), (1, 0, 2, 3, 1), (1, 1, 2, 3, 1)], "graph long, structure int, a int, b int, `order` int")
    got = {(r.a, r.b): (r.order, r.length) for r in graphs.averaged_bonds(rows, {1: 1.5, 2: 1.3}).collect()}
    assert got == {(1, 2): (1.5, pytest.approx(1.4)), (2, 3): (1.0, 1.5)}


def test_spill_and_last_states(spark, tmp_path):
    states = spark.createDataFrame([(f"s{k}", k) for k in range(10)], "key string, last_used int")
    rest = trajectories.spill(states, 0.4, str(tmp_path / "h"), 3)
    old = spark.read.parquet(str(tmp_path / "h"))
    assert old.count() + rest.count() == 10 and old.agg(F.max("last_used")).first()[0] < rest.agg(F.min("last_used")).first()[0]
    log = spark.createDataFrame([(1, 0, 1, "a", 2.0), (1, 0, 2, "b", 1.0)], "run long, replica int, step long, key string, f double")
    assert [tuple(r) for r in trajectories.last_states(log).collect()] == [(1, 0, 2, "b", 1.0)]


def test_long_chains_are_whole(spark, monkeypatch):
    """Keys, descriptors and runs of chains beyond 20 elements."""
    from kerntrail.plans import molecules, registry

    chains = {1: [6] * 8 + [7] + [6] * 14, 2: [6] * 11 + [7] + [6] * 11, 3: [6] * 14 + [7] + [6] * 8}
    atoms = spark.createDataFrame([(g, k + 1, z) for g, c in chains.items() for k, z in enumerate(c)], "graph long, atom int, z int")
    bonds = spark.createDataFrame([(g, k, k + 1, 1) for g, c in chains.items() for k in range(1, len(c))], "graph long, a int, b int, order int")
    key = {r.graph: r.key for r in canonical.graph_keys(atoms, bonds).collect()}
    assert key[1] == key[3] != key[2]
    classes = [r.members for r in canonical.equivalence(atoms, bonds).filter("graph < 3").orderBy("graph", "class").collect()]
    assert classes == [1] * 23 + [2] * 11 + [1]
    monkeypatch.setattr(molecules, "_both", lambda *_: (atoms, bonds))
    for r in registry.QUERIES["graph_descriptor"](spark, "").collect():
        c = chains[r.graph]
        trace = sum(0.5 * z**2.4 for z in c)
        assert r.n == 23 * 24 // 2 and abs(r.trace - trace) < 1e-3
        assert abs(r.upper - trace - sum(c[i] * c[j] / (j - i) for i in range(23) for j in range(i + 1, 23))) < 1e-3
