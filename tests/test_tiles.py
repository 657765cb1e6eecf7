"""Blocks of rows as they meet: packed, in bounded pieces, sent no more often than need be."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from kerntrail.operators import pairs, widths


def vectors(spark, x):
    return spark.createDataFrame([(k, [float(v) for v in row]) for k, row in enumerate(x)], "id long, x array<double>")


def test_a_tile_is_bounded_whatever_its_blocks(spark):
    x = np.random.default_rng(3).normal(size=(pairs.TILE + 200, 2))
    sizes = lambda i, a, j, b, same: pa.table({"n": [len(i)], "m": [len(j)], "same": [same]})
    found = pairs.tiles(vectors(spark, x), sizes, "n long, m long, same boolean", 1).collect()
    assert sorted(map(tuple, found)) == [(200, 200, True), (pairs.TILE, 200, False), (pairs.TILE, pairs.TILE, True)]


def test_blocks_grow_once_there_are_many():
    assert pairs.block_count(20_000) == 10 and pairs.block_count(100_000) == pairs.MANY
    assert pairs.block_count(615_000) == 615_000 // pairs.WIDE + 1


def test_a_band_has_few_blocks(spark, monkeypatch):
    sent, met = [], pairs.met
    monkeypatch.setattr(pairs, "met", lambda ls, rs, *more: sent.append(ls.count() + rs.count()) or met(ls, rs, *more))
    x = np.random.default_rng(4).uniform(size=(400, 2)) / 100
    v = vectors(spark, x)
    n = pairs.within(v.toDF("i", "a"), v.toDF("j", "b"), 1.0, block=4).count()
    assert n == 400 * 400 and sent[0] <= 2 * (pairs.BANDED + 1) ** 2


def test_vectors_are_packed_without_loss(spark):
    x = np.random.default_rng(5).normal(size=(10, 3))
    for given, single in ((x, False), (x.astype(np.float32), True)):
        cell = pairs.packed(vectors(spark, given).withColumn("p", F.lit(0)), "id", "x", {"p": "int"}).first()
        ids, back = pairs.unpacked(cell.ids, cell.xs, cell.single)
        assert cell.single == single and ids.tolist() == list(range(10)) and np.array_equal(back, given.astype(float))


def test_kernel_distances_need_no_join(spark):
    v = vectors(spark, np.random.default_rng(6).normal(size=(40, 3)))
    found = pairs.kernel_sqdist(v, "laplacian", 1.3, 2)
    assert "Join" not in found._jdf.queryExecution().toString()
    want = {(r.i, r.j): r.d2 for r in pairs.kernel_to_sqdist(pairs.kernel_entries(v, "laplacian", 1.3, 2)).collect()}
    got = {(r.i, r.j): r.d2 for r in found.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_slopes_of_classes_by_either_kernel(spark):
    x = np.random.default_rng(7).normal(size=(12, 4))
    own, classes = [0.5, 1.0, 1.5, 2.0], [0, 1, 0, 1]
    for name, power in (("gaussian", 2), ("laplacian", 1)):
        q = np.abs((x[:, None] - x) / own) ** power
        k = np.exp(-q.sum(-1) / power)
        for r in widths.kernel_slopes(vectors(spark, x), name, own, 2, classes).collect():
            want = [k[r.i, r.j] * sum(q[r.i, r.j, c] / own[c] for c in range(4) if classes[c] == g) for g in (0, 1)]
            assert np.allclose(r.dk, want, atol=1e-12)


def test_ordered_pairs_are_those_of_the_smaller_id(spark):
    v = vectors(spark, np.append(np.random.default_rng(8).normal(size=(50, 3)), np.ones((2, 3)), axis=0))
    left, right = v.toDF("i", "a"), v.toDF("j", "b")
    for high in (1.5, 0):
        every = {(r.i, r.j) for r in pairs.within(left, right, high).collect()}
        half = {(r.i, r.j) for r in pairs.within(left, right, high, ordered=True).collect()}
        assert half and half == {(i, j) for i, j in every if i < j}
