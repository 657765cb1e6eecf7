"""Bond orders and resonance structures against trying all orders of all bonds."""

import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from kerntrail.functions import vectors as V
from kerntrail.operators import graphs, resonance

ATOMS, BONDS = "graph long, atom int, z int, hydrogens int", "graph long, a int, b int"


def frames(spark, molecules):
    """molecules: {id: ([(element, hydrogens)], [(a, b)])}, atoms from 0."""
    atoms = spark.createDataFrame([(g, k, z, h) for g, (zs, _) in molecules.items() for k, (z, h) in enumerate(zs)], ATOMS)
    return atoms, spark.createDataFrame([(g, *sorted(e)) for g, (_, es) in molecules.items() for e in es], BONDS)


def ring(n):
    return [(k, (k + 1) % n) for k in range(n)]


NAPHTHALENE = [(6, 1)] * 4 + [(6, 0)] + [(6, 1)] * 4 + [(6, 0)], [*ring(10), (4, 9)]
KNOWN = {
    1: ([(6, 1)] * 6, ring(6)),  # benzene
    2: NAPHTHALENE,
    3: ([(6, 1)] * 5, ring(5)),  # no way for five
    4: ([(6, 3), (6, 0), (7, 0)], [(0, 1), (1, 2)]),  # acetonitrile
    5: ([(6, 3), (16, 0), (8, 0), (8, 0), (8, 1)], [(0, 1), (1, 2), (1, 3), (1, 4)]),  # a sulphonic acid: sulphur takes six
    6: ([(6, 0), (8, 0), (8, 0)], [(0, 1), (0, 2)]),  # carbon dioxide
    7: ([(6, 4)], []),
    8: ([(6, 5)], []),
    9: ([(6, 2)], []),  # spare valences and nobody to share them
    10: ([(7, 0), (7, 0)], [(0, 1)]),
    11: ([(6, 0), (6, 0)], [(0, 1)]),  # four bonds between two
    12: ([(6, 1)] * 6 + [(6, 3)], [*ring(6)]),  # an atom apart that can't be
}


def brute(zs, es):
    """All structures with the least sum of valences, as tuples of orders; none where there is none."""
    near = [sum(v in e for e in es) for v in range(len(zs))]
    found: dict[int, list[tuple]] = {}
    for orders in product((1, 2, 3), repeat=len(es)):
        used = [h + sum(o for e, o in zip(es, orders, strict=True) if v in e) for v, (_, h) in enumerate(zs)]
        if all(u in V.VALENCES[z] for u, (z, _) in zip(used, zs, strict=True)):
            found.setdefault(sum(used), []).append(orders)
    assert len(near) == len(zs)
    return sorted(found[min(found)]) if found else []


def check(spark, molecules):
    atoms, bonds = frames(spark, molecules)
    bonded = {(r.graph, r.a, r.b): r for r in resonance.bond_orders(atoms, bonds).collect()}
    rows = resonance.resonance_structures(atoms, bonds).collect()
    for g, (zs, es) in molecules.items():
        want = brute(zs, es)
        own = [bonded[(g, *sorted(e))] for e in es]
        if not want:
            assert all(r.order is None and r["mean"] is None and r.structures == 0 for r in own) and not any(r.graph == g for r in rows)
            continue
        assert tuple(r.order for r in own) in want
        assert [r["mean"] for r in own] == pytest.approx([sum(w[k] for w in want) / len(want) for k in range(len(es))])
        # all combinations of the regions' structures are the molecule's
        regions: dict[int, dict[int, dict]] = {}
        for r in rows:
            if r.graph == g:
                regions.setdefault(r.region, {}).setdefault(r.structure, {})[r.a, r.b] = r.order
        combined = []
        for some in product(*[list(x.values()) for x in regions.values()]):
            whole = {k: v for part in some for k, v in part.items()}
            combined.append(tuple(whole.get(tuple(sorted(e)), 1) for e in es))
        assert sorted(combined) == want
        counts = {r.region: r.structures for r in own if r.region is not None}
        assert counts == {k: len(x) for k, x in regions.items()}


def test_known_molecules(spark):
    check(spark, {g: m for g, m in KNOWN.items() if g != 2})
    atoms, bonds = frames(spark, KNOWN)
    found = resonance.bond_orders(atoms, bonds)
    assert {tuple(r) for r in found.filter("graph = 1").select("mean", "structures").collect()} == {(1.5, 2.0)}
    naphthalene = {(r.a, r.b): round(r["mean"], 6) for r in found.filter("graph = 2").collect()}
    assert {r.structures for r in found.filter("graph = 2").collect()} == {3.0}
    assert naphthalene[0, 1] == naphthalene[2, 3] == round(5 / 3, 6) and naphthalene[1, 2] == naphthalene[4, 9] == round(4 / 3, 6)
    assert [r.order for r in found.filter("graph = 4").orderBy("a").collect()] == [1, 3]
    assert sorted(r.order for r in found.filter("graph = 5").collect()) == [1, 1, 2, 2]


def test_random_molecules_by_brute_force(spark):
    rng = random.Random(6)
    molecules = {}
    for g in range(150):
        n = rng.randint(2, 6)
        es = [(rng.randrange(k), k) for k in range(1, n) if rng.random() < 0.95]
        es += [e for e in ((a, b) for a in range(n) for b in range(a + 1, n)) if e not in es and rng.random() < 0.15]
        near = [sum(v in e for e in es) for v in range(n)]
        zs = [(z, rng.randint(0, max(0, max(V.VALENCES[z]) - near[v]))) for v, z in enumerate(rng.choices([6, 6, 7, 8, 15, 16], k=n))]
        molecules[g] = zs, es
    check(spark, molecules)
    assert 10 < sum(bool(brute(*m)) for m in molecules.values()) < 140


def test_very_many_structures_are_counted(spark):
    """A ladder of 40 squares of carbons: its perfect matchings are Fibonacci's numbers."""
    n = 41
    es = [(2 * k, 2 * k + 1) for k in range(n)] + [(2 * k + j, 2 * k + 2 + j) for k in range(n - 1) for j in (0, 1)]
    near = [sum(v in e for e in es) for v in range(2 * n)]
    atoms, bonds = frames(spark, {1: ([(6, 3 - near[v]) for v in range(2 * n)], es)})
    a, b = 1, 2
    for _ in range(n - 2):
        a, b = b, a + b
    assert {r.structures for r in resonance.bond_orders(atoms, bonds).collect()} == {float(b)}


def test_lengths_from_mean_orders(spark):
    atoms, bonds = frames(spark, KNOWN)
    orders = resonance.bond_orders(atoms, bonds)
    got = {round(r.length, 6) for r in resonance.structure_lengths(orders.filter("graph = 1"), {1: 1.5, 2: 1.3}).collect()}
    assert got == {1.4}
    by_rows = graphs.averaged_bonds(resonance.resonance_structures(atoms, bonds).filter("graph = 2"), {1: 1.5, 2: 1.3})
    same = by_rows.join(resonance.structure_lengths(orders, {1: 1.5, 2: 1.3}).select("graph", "a", "b", F.col("length").alias("other")), ["graph", "a", "b"])
    assert same.count() == 11 and same.filter("abs(length - other) > 1e-9").count() == 0


def test_without_rows(spark):
    atoms, bonds = frames(spark, KNOWN)
    assert resonance.bond_orders(atoms.filter("graph < 0"), bonds.filter("graph < 0")).count() == 0
    assert resonance.resonance_structures(atoms.filter("graph < 0"), bonds.filter("graph < 0")).count() == 0
