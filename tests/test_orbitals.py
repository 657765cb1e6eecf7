"""Nested kernels and their slopes against loops and differences."""

import numpy as np
import pytest

from kerntrail.operators import orbitals as O

SCHEMA = "id int, part int, rho double, comps array<struct<rho:double,v:array<double>>>"


def molecules(spark, n=7, seed=2):
    rng = np.random.default_rng(seed)
    data = [(m, p, float(rng.uniform(0.5, 2)), [(float(rng.uniform(-0.5, 1)), [float(v) for v in rng.normal(size=3)]) for _ in range(rng.integers(1, 5))]) for m in range(n) for p in range(rng.integers(1, 4))]
    return data, spark.createDataFrame(data, SCHEMA)


def plain(data, sigma, width=None, normalise=False):
    """The kernel by loops, for any widths of components."""
    sigma = np.broadcast_to(np.asarray(sigma, float), 3)

    def part(a, b):
        return sum(x * y * np.exp(-(((np.array(u) - v) / sigma) ** 2).sum() / 4) for x, u in a for y, v in b)

    out = {}
    for i in {r[0] for r in data}:
        for j in {r[0] for r in data if r[0] >= i}:
            total = 0.0
            for p in (r for r in data if r[0] == i):
                for q in (r for r in data if r[0] == j):
                    k = part(p[3], q[3])
                    if normalise:
                        k /= np.sqrt(part(p[3], p[3]) * part(q[3], q[3]))
                    total += p[2] * q[2] * (k if width is None else np.exp(-(1 - k) / width**2))
            out[i, j] = total
    return out


@pytest.mark.parametrize("normalise", [False, True])
@pytest.mark.parametrize("width", [None, 0.8])
@pytest.mark.parametrize("sigma", [1.1, [0.9, 1.4, 2.0]])
def test_kernels_and_slopes(spark, sigma, width, normalise, monkeypatch):
    monkeypatch.setattr(O, "CELLS", 40)
    data, parts = molecules(spark)
    want, h = plain(data, sigma, width, normalise), 1e-5
    rows = O.molecule_kernel(parts, sigma, 2, width, slope=True, normalise=normalise).collect()
    assert {(r.i, r.j) for r in rows} == set(want) and len(rows) == len(want)
    steps = [np.float64(h)] if isinstance(sigma, float) else list(h * np.eye(3))
    slopes = [(plain(data, np.asarray(sigma) + s, width, normalise), plain(data, np.asarray(sigma) - s, width, normalise)) for s in steps]
    by_width = width and (plain(data, sigma, width + h, normalise), plain(data, sigma, width - h, normalise))
    for r in rows:
        at = r.i, r.j
        assert r.k == pytest.approx(want[at], rel=1e-9)
        assert np.allclose(r.dk, [(up[at] - down[at]) / (2 * h) for up, down in slopes], atol=1e-6)
        assert not width or r.dwidth == pytest.approx((by_width[0][at] - by_width[1][at]) / (2 * h), abs=1e-6)


def test_normalising_inside_equals_normalising_before(spark):
    _, parts = molecules(spark)
    one = {(r.i, r.j): r.k for r in O.molecule_kernel(O.normalised(parts, 1.3), 1.3, 1).collect()}
    other = {(r.i, r.j): r.k for r in O.molecule_kernel(parts, 1.3, 3, normalise=True).collect()}
    assert one.keys() == other.keys() and all(one[k] == pytest.approx(other[k]) for k in one)


def test_parts_without_components(spark):
    data = [(1, 0, 1.0, [(1.0, [0.0, 0.0, 0.0])]), (1, 1, 2.0, []), (2, 0, 1.0, []), (3, 0, 1.0, [(0.0, [1.0, 0.0, 0.0])])]
    parts = spark.createDataFrame(data, SCHEMA)
    assert {(r.i, r.j): r.k for r in O.molecule_kernel(parts, 1.0, 2).collect()} == {(1, 1): 1.0, (1, 2): 0.0, (1, 3): 0.0, (2, 2): 0.0, (2, 3): 0.0, (3, 3): 0.0}
    assert {(r.i, r.j): r.k for r in O.molecule_kernel(parts, 1.0, 1, width=1.0, normalise=True).collect()}[1, 1] == 1.0
    assert O.molecule_kernel(parts.filter("id < 0"), 1.0, 2).count() == 0
