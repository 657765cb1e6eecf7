"""Record operators against plain Python."""

import numpy as np
from pyspark.sql import functions as F

from kerntrail.operators import records, ridge


def test_convex_hull(spark):
    rng = np.random.default_rng(1)
    points = np.vstack([rng.normal(size=(200, 2)), [[9, 9], [9, -9], [-9, 9], [-9, -9], [9, 0], [9, 9]]])
    frame = spark.createDataFrame([(float(a), float(b)) for a, b in points] + [(None, 1.0)], "u double, v double").repartition(3)
    assert {(r.u, r.v) for r in records.convex_hull(frame).collect()} == {(9.0, 9.0), (9.0, -9.0), (-9.0, 9.0), (-9.0, -9.0)}
    line = spark.createDataFrame([(float(k), float(k)) for k in range(5)], "u double, v double")
    assert {(r.u, r.v) for r in records.convex_hull(line).collect()} == {(0.0, 0.0), (4.0, 4.0)}
    assert records.convex_hull(line.limit(0)).count() == 0


def test_neighbours(spark):
    states = spark.createDataFrame([(1, [6, 7]), (2, [8]), (3, [])], "graph long, chain array<int>")
    got = {(r.graph, r.kind, tuple(r.chain)) for r in records.neighbours(states, [6, 7], 2).collect()}
    assert got == {(1, "replace", (7, 7)), (1, "replace", (6, 6)), (1, "remove", (6,)), (2, "replace", (6,)), (2, "replace", (7,)), (2, "add", (8, 6)), (2, "add", (8, 7))}


def test_levels_without_free_ones(spark):
    row = spark.range(1).select(*records.levels(F.array(F.lit(-2.0), F.lit(-1.0)), F.array(F.lit(2.0), F.lit(2.0)))).first()
    assert (row.homo, row.lumo, row.gap) == (-1.0, None, None)


def test_saturation_finds_its_curve(spark):
    curve = spark.range(1, 40).select(F.col("id").cast("double").alias("x"), (7.0 * F.col("id") / (3.0 + F.col("id"))).alias("y"))
    row = records.saturation(curve).first()
    assert abs(row.a - 7) < 1e-9 and abs(row.b - 3) < 1e-9


def test_saturation_equals_least_squares_on_noisy_curves(spark):
    """Against Gauss-Newton in numpy on all rows, from another start."""
    rng = np.random.default_rng(51)
    for a, b, noise in ((7.0, 3.0, 0.3), (120.0, 40.0, 5.0), (2.0, 0.5, 0.05)):
        x = rng.integers(1, 60, 400).astype(float)
        y = a * x / (b + x) + noise * rng.normal(size=400)
        p = np.array([a, b])
        for _ in range(100):
            j = np.stack([x / (p[1] + x), -p[0] * x / (p[1] + x) ** 2], axis=1)
            p = p + np.linalg.lstsq(j, y - p[0] * x / (p[1] + x), rcond=None)[0]
        row = records.saturation(spark.createDataFrame([(float(u), float(v)) for u, v in zip(x, y, strict=True)] + [(0.0, 1.0), (3.0, None)], "x double, y double")).first()
        assert abs(row.a - p[0]) < 1e-6 * a and abs(row.b - p[1]) < 1e-6 * b
    assert tuple(records.saturation(spark.createDataFrame([], "x double, y double")).first()) == (None, None)


def test_prefix_diversity_equals_singular_values(spark):
    x = np.random.default_rng(2).normal(size=(40, 4))
    frame = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, x array<double>")
    for r in records.prefix_diversity(frame, 4).collect():
        s = np.linalg.svd(x[: r.rows], compute_uv=False)[:2]
        assert abs(r.diversity - np.sqrt((s * s).sum())) < 1e-9


def test_fold_errors_equal_separate_fits(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 3))
    rows = spark.createDataFrame([(i, r.tolist(), [float(r[0] + r[1] ** 2)]) for i, r in enumerate(x)], "id long, x array<double>, y array<double>")
    got = ridge.fold_errors(rows, F.col("id") % 3, 1.0, [0.1]).first()
    errors = []
    marks = ridge.landmarks(rows)
    for fold in range(3):
        equations = ridge.normal_equations(rows.filter(F.col("id") % 3 != fold).withColumn("bucket", F.lit(0)), marks, "gaussian", 1.0)[0]
        model = {"marks": marks, "name": "gaussian", "sigma": 1.0, "coefficients": [ridge.solve(equations, marks, "gaussian", 1.0, 0.1)]}
        errors += [abs(r.prediction[0][0] - r.y[0]) for r in ridge.predict(rows.filter(F.col("id") % 3 == fold), model, ["y"]).collect()]
    assert abs(got.mae - np.mean(errors)) < 1e-6


def test_crossings(spark):
    chains = spark.createDataFrame([(1, [6, 7, 8]), (2, [8, 8])], "graph long, chain array<int>")
    bonds = spark.createDataFrame([(1, 1, 2, 1), (1, 2, 3, 2), (2, 1, 2, 1)], "graph long, a int, b int, `order` int")
    couples = spark.createDataFrame([(1, 2)], "left long, right long")
    assert [tuple(r.chain) for r in records.crossings(couples, chains, bonds, 5).collect()] == [(6, 8)]
