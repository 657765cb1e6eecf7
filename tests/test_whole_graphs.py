"""Graphs worked out whole inside tasks: searched once, summed where they are, no row for each pair of atoms or each move sent."""

import numpy as np
import pytest

from kerntrail.operators import canonical, graphs, molecules
from kerntrail.plans.tables import atom_rows, bond_rows


def tables(spark, shapes):
    """shapes: for each graph its elements and bonds (a, b, order), atoms counted from 1."""
    atoms = [(g, k + 1, z) for g, (zs, _) in enumerate(shapes) for k, z in enumerate(zs)]
    bonds = [(g, a, b, o) for g, (_, es) in enumerate(shapes) for a, b, o in es]
    return spark.createDataFrame(atoms, "graph long, atom int, z int"), spark.createDataFrame(bonds, "graph long, a int, b int, order int")


RING = ([6, 6, 6, 6], [(1, 2, 1), (2, 3, 1), (3, 4, 1), (1, 4, 1)])
STAR = ([7, 6, 6, 8], [(1, 2, 1), (1, 3, 1), (1, 4, 1)])


def test_equal_graphs_are_searched_once(monkeypatch):
    n, seen, search = 50, [], canonical.searched
    monkeypatch.setattr(canonical, "KNOWN", {})
    monkeypatch.setattr(canonical, "searched", lambda g: seen.append(len(g["size"])) or search(g))
    g = {
        "graph": np.arange(n), "size": np.full(n, 4), "start": np.arange(n) * 4, "atom": np.tile([1, 2, 3, 4], n), "z": np.full(4 * n, 6), "owner": np.repeat(np.arange(n), 4),
        "of": np.repeat(np.arange(n), 4), "a": (np.arange(n)[:, None] * 4 + [0, 1, 2, 0]).ravel(), "b": (np.arange(n)[:, None] * 4 + [1, 2, 3, 3]).ravel(), "order": np.ones(4 * n),
    }
    first, again = canonical.labels(g), canonical.labels(g)
    assert seen == [1] and first.equals(again) and len(set(first["key"].to_pylist())) == 1 and set(first["orbit"].to_pylist()) == {1}


def test_carbonised_keys_whole_and_by_joins(spark):
    atoms, bonds = tables(spark, [STAR, RING, ([6, 6, 6, 6], STAR[1]), ([6], [])])
    bare = molecules.carbonised(atoms, bonds)
    want = {r.graph: (r.key, r.bare) for r in canonical.graph_keys(atoms, bonds).join(canonical.graph_keys(bare, bonds).withColumnRenamed("key", "bare"), "graph").collect()}
    got = canonical.carbonised_keys(atoms, bonds, 6, 4).collect()
    assert {r.graph: (r.key, r.bare) for r in got} == want and {r.graph for r in got if r.pure} == {1, 2, 3}
    joined = {r.graph: r for r in canonical.carbonised_keys(atoms, bonds, 6, 4, most=1).collect()}
    assert len(joined) == 4 and {g for g, r in joined.items() if r.pure} == {1, 2, 3}


@pytest.mark.parametrize("most", [256, 2])
def test_descriptor_totals(spark, most):
    atoms, bonds = tables(spark, [RING, STAR])
    got = {r.graph: (r.n, r.hops, r.orders) for r in graphs.descriptor_totals(atoms, bonds, 5, most).collect()}
    assert got == {0: (4, 8.0, 4.0), 1: (4, 9.0, 3.0)}


def test_bonds_need_no_join(spark, data):
    bonds = bond_rows(atom_rows(spark, data))
    assert "Join" not in bonds._jdf.queryExecution().toString()
