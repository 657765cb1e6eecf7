"""Bond orders from hydrogens: assignments of spare valences to bonds, all resonance structures and their mean orders."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from . import graphs as G

#: What a bond can have above a single one.
MOST = 2
#: Rows of structures that are handed on at once.
ROWS = 50_000

#: choices: for each atom of a region what it may spend on bonds above single ones; edges: pairs of its atoms.
Choices, Edges = tuple[tuple[int, ...], ...], tuple[tuple[int, int], ...]


class Region:
    """The structures of a connected region: what each bond has above a single one, so that all atoms spend one of their choices and the sum
    of what is spent is least.

    Bonds are taken one after the other. Between two bonds only atoms with bonds on both sides matter, by what each has spent: so the
    structures are the ways through layers of such states, counted from either end.
    """

    def __init__(self, choices: Choices, edges: Edges):
        self.choices = choices
        self.order = self.walk(len(choices), edges)
        self.edges = [edges[k] for k in self.order]
        first, last = {}, {}
        for k, e in enumerate(self.edges):
            for v in e:
                first.setdefault(v, k)
                last[v] = k
        #: At each layer the atoms whose spending is known in part.
        self.open = [[v for v in first if first[v] < k <= last[v]] for k in range(len(self.edges) + 1)]
        self.last = last
        lone = [v for v in range(len(choices)) if v not in first]
        self.possible = all(0 in choices[v] for v in lone)
        self.ahead: list[dict[tuple, tuple[int, int]]] = [{} for _ in range(len(self.edges) + 1)]
        self.ahead[-1][()] = 0, 1
        states: list[set[tuple]] = [{()}]
        for k in range(len(self.edges)):
            states.append({after for s in states[-1] for _, _, after in self.steps(k, s)})
        for k in range(len(self.edges) - 1, -1, -1):
            for s in states[k]:
                best, ways = None, 0
                for _, cost, after in self.steps(k, s):
                    if after in self.ahead[k + 1]:
                        more, many = self.ahead[k + 1][after]
                        if best is None or cost + more < best:
                            best, ways = cost + more, many
                        elif cost + more == best:
                            ways += many
                if best is not None:
                    self.ahead[k][s] = best, ways
        self.count = self.ahead[0].get((), (0, 0))[1] if self.possible else 0

    @staticmethod
    def walk(n: int, edges: Edges) -> list[int]:
        """The bonds in the order in which a breadth-first walk from the first atom closes them, which keeps few atoms open."""
        near: list[list[int]] = [[] for _ in range(n)]
        for a, b in edges:
            near[a].append(b)
            near[b].append(a)
        place, queue = {0: 0}, [0]
        for v in queue:
            for u in sorted(near[v]):
                if u not in place:
                    place[u] = len(queue)
                    queue.append(u)
        ends = [sorted((place[a], place[b]), reverse=True) for a, b in edges]
        return sorted(range(len(edges)), key=lambda k: ends[k])

    def steps(self, k: int, state: tuple) -> Iterator[tuple[int, int, tuple]]:
        """(what bond k gets above a single one, what atoms that it closes have spent, the next state)."""
        spent = dict(zip(self.open[k], state, strict=True))
        a, b = self.edges[k]
        for more in range(MOST + 1):
            now = spent | {a: spent.get(a, 0) + more, b: spent.get(b, 0) + more}
            if any(now[v] > max(self.choices[v]) or self.last[v] == k and now[v] not in self.choices[v] for v in (a, b)):
                continue
            cost = sum(now[v] for v in (a, b) if self.last[v] == k)
            yield more, cost, tuple(now[v] for v in self.open[k + 1])

    def best_steps(self, k: int, state: tuple) -> Iterator[tuple[int, tuple, int]]:
        """(what bond k gets, the next state, structures from there) of the steps that lie on best ways."""
        least = self.ahead[k][state][0]
        for more, cost, after in self.steps(k, state):
            if after in self.ahead[k + 1] and cost + self.ahead[k + 1][after][0] == least:
                yield more, after, self.ahead[k + 1][after][1]

    def structures(self) -> Iterator[list[int]]:
        """Each structure once, as what its bonds, in the order given, have above single ones; every step leads to one."""
        if not self.count:
            return
        stack = [(0, (), [])]
        while stack:
            k, state, taken = stack.pop()
            if k == len(self.edges):
                out = [0] * k
                for at, more in zip(self.order, taken, strict=True):
                    out[at] = more
                yield out
                continue
            stack += [(k + 1, after, [*taken, more]) for more, after, _ in sorted(self.best_steps(k, state), reverse=True)]

    def means(self) -> list[float]:
        """What the bonds, in the order given, have above single ones in the mean over all structures, by counting alone."""
        out, behind = [0.0] * len(self.edges), {(): 1}
        for k in range(len(self.edges)):
            then: dict[tuple, int] = {}
            total = 0
            for state, ways in behind.items():
                for more, after, many in self.best_steps(k, state):
                    then[after] = then.get(after, 0) + ways
                    total += more * ways * many
            out[self.order[k]] = total / self.count
            behind = then
        return out


@lru_cache(maxsize=20_000)
def region(choices: Choices, edges: Edges) -> Region:
    """Molecules share their regions: a worker works each out once."""
    return Region(choices, edges)


def regions(g: dict[str, np.ndarray], valences: dict[int, list[int]]) -> Iterator[tuple[int, bool, list[tuple[list[int], list[int], Region]]]]:
    """For each graph its number, whether its atoms can have such coordinations, and its regions: atoms, bonds (places) and structures.

    A region is a connected part of atoms that could have more bonds than neighbours and hydrogens.
    """
    first = np.searchsorted(g["of"], np.arange(len(g["size"]) + 1))
    neighbours = np.bincount(np.append(g["a"], g["b"]), minlength=len(g["z"]))
    for k, (start, size) in enumerate(zip(g["start"].tolist(), g["size"].tolist(), strict=True)):
        spare: dict[int, tuple[int, ...]] = {}
        valid = True
        for v in range(start, start + size):
            used = int(neighbours[v] + g["hydrogens"][v])
            options = [n for n in valences.get(int(g["z"][v]), []) if n >= used]
            valid &= bool(options)
            if options and options[-1] > used:
                spare[v] = tuple(n - used for n in options)
        ends = [(e, int(g["a"][e]), int(g["b"][e])) for e in range(first[k], first[k + 1])]
        inner = [x for x in ends if x[1] in spare and x[2] in spare]
        label = {v: v for v in spare}

        def find(v: int, label: dict[int, int] = label) -> int:
            while label[v] != v:
                label[v] = label[label[v]]
                v = label[v]
            return v

        for _, a, b in inner:
            a, b = find(a), find(b)
            label[max(a, b)] = min(a, b)
        parts: dict[int, tuple[list[int], list[tuple[int, int, int]]]] = {}
        for v in sorted(spare):
            parts.setdefault(find(v), ([], []))[0].append(v)
        for x in inner:
            parts[find(x[1])][1].append(x)
        found = []
        for members, bonds in parts.values():
            number = {v: i for i, v in enumerate(members)}
            own = region(tuple(spare[v] for v in members), tuple((number[a], number[b]) for _, a, b in bonds))
            found.append((members, [e for e, _, _ in bonds], own))
        yield k, valid and all(own.count for _, _, own in found), found


def _prepared(atoms: DataFrame, bonds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hydrogens travel with elements: 1,000 times their number is added to z."""
    packed = F.col("z") + 1000 * F.coalesce("hydrogens", F.lit(0))
    return atoms.select("graph", "atom", packed.cast("int").alias("z")), bonds.select("graph", "a", "b", F.lit(1.0).alias("order"))


def _unpacked(g: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return g | {"z": g["z"] % 1000, "hydrogens": g["z"] // 1000}


def bond_orders(atoms: DataFrame, bonds: DataFrame, valences: dict[int, list[int]] | None = None) -> DataFrame:
    """atoms(graph, atom, z, hydrogens), bonds(graph, a, b) -> (graph, a, b, order, mean, region, structures) for each bond.

    Each atom has one of its element's valences (vectors.VALENCES), which its hydrogens and bonds use up; bonds have three at most. Of all
    ways those with the least sum of valences count, region by region (named by its least atom; NULL for bonds between atoms that can
    have no more): order is that of the first structure, mean that over all `structures` of the region, which are counted, not
    listed. order and mean are NULL, and structures 0, throughout a graph that has no way at all. Orders that bonds come with don't matter; a graph
    comes to one task.
    """
    valences = valences or V.VALENCES

    def work(g: dict[str, np.ndarray]) -> pa.Table:
        g = _unpacked(g)
        n = len(g["of"])
        order, mean, part, many = np.ones(n), np.ones(n), np.full(n, -1, np.int64), np.ones(n)
        known = np.ones(n, bool)
        for k, valid, found in regions(g, valences):
            if not valid:
                own = g["of"] == k
                known[own], many[own] = False, 0
            for members, edges, own in found:
                part[edges] = members[0]
                if valid and edges:
                    order[edges] += next(own.structures())
                    mean[edges] += own.means()
                    many[edges] = float(own.count)
        number = g["atom"].astype(np.int32)
        named = pa.array(number[part], mask=part < 0)
        return pa.table({
            "graph": g["graph"][g["of"]], "a": number[g["a"]], "b": number[g["b"]], "order": pa.array(order.astype(np.int32), mask=~known),
            "mean": pa.array(mean, mask=~known), "region": named, "structures": many,
        })

    return G.per_graph(*_prepared(atoms, bonds), work, "graph long, a int, b int, order int, mean double, region int, structures double")


def resonance_structures(atoms: DataFrame, bonds: DataFrame, valences: dict[int, list[int]] | None = None) -> DataFrame:
    """The same input -> (graph, region, structure, a, b, order): every structure of every region, numbered from 0, and its bonds' orders.

    Regions without bonds, or with nothing to choose, have one structure; graphs without a way have no rows. Structures are handed on as they are found, so a task
    holds few of a region's, which may be very many.
    """
    valences = valences or V.VALENCES
    schema = "graph long, region int, structure long, a int, b int, order int"

    def batches(g: dict[str, np.ndarray]) -> Iterator[pa.Table]:
        g = _unpacked(g)
        number, rows = g["atom"].astype(np.int32), []

        def table() -> pa.Table:
            columns = [np.array(x) for x in zip(*rows, strict=True)]
            kinds = [np.int64, np.int32, np.int64, np.int32, np.int32, np.int32]
            return pa.table(dict(zip(["graph", "region", "structure", "a", "b", "order"], [c.astype(t) for c, t in zip(columns, kinds, strict=True)], strict=True)))

        for k, valid, found in regions(g, valences):
            for members, edges, own in found if valid else ():
                for s, extra in enumerate(own.structures()):
                    rows += [(g["graph"][k], number[members[0]], s, number[g["a"][e]], number[g["b"][e]], 1 + more) for e, more in zip(edges, extra, strict=True)]
                    if len(rows) >= ROWS:
                        yield table()
                        rows.clear()
        if rows:
            yield table()

    return G.per_graph(*_prepared(atoms, bonds), batches, schema)


def structure_lengths(orders: DataFrame, lengths: dict[int, float]) -> DataFrame:
    """bond_orders(...) -> (graph, a, b, order, length): mean orders, and lengths interpolated between those of the whole orders around them."""
    return G.interpolated(orders.select("graph", "a", "b", F.col("mean").alias("order")), lengths)
