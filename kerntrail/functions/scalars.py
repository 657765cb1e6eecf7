"""Column builders for elements, valences, gates, lists and small objectives."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vectors as V

#: Electrons in the outer shell by element.
OUTER = {1: 1, 5: 3, 6: 4, 7: 5, 8: 6, 9: 7, 14: 4, 15: 5, 16: 6, 17: 7, 35: 7, 53: 7}


def element_case(symbol: Column) -> Column:
    """An element's symbol with its first letter in upper case and the others in lower case."""
    return F.concat(F.upper(F.substring(symbol, 1, 1)), F.lower(F.substring(symbol, 2, 1 << 20)))


def any_of(values: Column, options: Sequence) -> Column:
    """Whether one of the options is in a list; false for an empty list, NULL for NULL."""
    return F.arrays_overlap(F.filter(values, lambda v: v.isNotNull()), F.array(*map(F.lit, options)))


def repeated(keys: Sequence[str], value: Column) -> Column:
    """A map that gives all keys one value."""
    return F.create_map(*[x for k in keys for x in (F.lit(k), value)])


def masked(x: Column, mask: Column) -> Column:
    """Zero where the mask is true."""
    return F.zip_with(x, mask, lambda v, m: F.when(m, 0.0).otherwise(v))


def selected(x: Column, mask: Column) -> Column:
    """The components where the mask is true, in order."""
    return F.transform(F.filter(F.arrays_zip(x.alias("v"), mask.alias("m")), lambda s: s["m"]), lambda s: s["v"])


def square_form(flat: Column, n: Column) -> Column:
    """The symmetric matrix with zeros on its diagonal whose upper triangle is the list."""

    def place(i: Column, j: Column) -> Column:
        low, high = F.least(i, j), F.greatest(i, j)
        return (low * n - F.floor(low * (low + 1) / 2) + high - low - 1).cast("int")

    rows = F.sequence(F.lit(0), n - 1)
    return F.transform(rows, lambda i: F.transform(rows, lambda j: F.when(i == j, 0.0).otherwise(F.get(flat, place(i, j)))))


def nonzero(x: Column) -> Column:
    """The list without its padding."""
    return F.filter(x, lambda v: v != 0)


def padded_matrix(rows: Column, n: int, m: int) -> Column:
    """Cut or filled with zeros to n rows of m numbers."""
    empty = F.array_repeat(F.lit(0.0), m)
    return F.slice(F.concat(F.transform(rows, lambda r: V.padded(r, m)), F.array_repeat(empty, n)), 1, n)


def gate(donors: Column, acceptors: Column, weight: Column, log_p: Column, rotatable: Column, rings: Column) -> Column:
    """The usual limits of what may be taken by mouth, and at least one ring."""
    return (donors <= 5) & (acceptors <= 5) & (weight < 500) & (log_p < 5) & (rotatable <= 5) & (rings > 0)


def powered(value: Column, multiplier: Column, power: float, low: float | None = None, high: float | None = None) -> Column:
    """value times multiplier^power; NULL where the value is out of bounds."""
    return V.bounded(value, low, high) * F.pow(multiplier, power)


def next_valence(z: Column, valence: Column, up: bool = True) -> Column:
    """The next greater (or smaller) valence that an element has; NULL if there is none."""
    known = V.lookup(V.VALENCES, z)
    return F.array_min(F.filter(known, lambda v: v > valence)) if up else F.array_max(F.filter(known, lambda v: v < valence))


def least_valence(z: Column, used: Column) -> Column:
    """The least valence of an element that its bonds leave possible; NULL if there is none."""
    return F.array_min(F.filter(V.lookup(V.VALENCES, z), lambda v: v >= used))


def unshared_pairs(z: Column, valence: Column) -> Column:
    """Pairs of outer electrons that no bond of the valence takes."""
    return F.floor((V.lookup(OUTER, z) - valence) / 2).cast("int")


def hybridisation(coordination: Column) -> Column:
    """sp3, sp2 or sp by the number of neighbours and unshared pairs; NULL for others."""
    return F.element_at(F.array(F.lit("sp"), F.lit("sp2"), F.lit("sp3")), F.when(coordination.between(2, 4), coordination - 1).cast("int"))


def polyvalent(z: Column) -> Column:
    return F.size(V.lookup(V.VALENCES, z)) > 1


def log_share(count: Column, total: Column) -> Column:
    """The logarithm of a probability; NULL for none."""
    return F.when(count > 0, F.log(count / total))


def log_ratio_error(shares: Column) -> Column:
    """sqrt of the mean of 1 / p - 1 over a column of probabilities, an aggregate."""
    return F.sqrt(F.avg(1 / shares - 1))


def in_interval(n: Column, intervals: Sequence[tuple[int, int]]) -> Column:
    """The number of the interval (both ends inside) that holds n; NULL for none."""
    return F.coalesce(*[F.when(n.between(a, b), F.lit(k)) for k, (a, b) in enumerate(intervals)])


def diatomic_barrier(za: Column, zb: Column, order: Column, greatest: int) -> Column:
    """0 for two of the smaller element, 1 for two of the greater, 2 for one of each; and one less than the bond's order."""
    return F.when(za != zb, 2).when(za == greatest, 1).otherwise(0) + order - 1


def order_slide(charges: Column, elements: Sequence[int]) -> Column:
    """Minus the sum of the elements' places in their order."""
    place = {z: k for k, z in enumerate(sorted(elements))}
    return -F.aggregate(charges, F.lit(0), lambda s, z: s + V.lookup(place, z))


def exponential_betas(low: float, n: int, ratio: float) -> list[float]:
    """n falling numbers c / (b^k - 1), k from 1, of which the last is low and the one before `ratio` times as great."""
    if n < 2 or ratio <= 1:
        raise ValueError("two numbers at least, and a ratio above 1")
    # (b^n - 1) / (b^(n-1) - 1) rises with b, as sums of powers show: the ratio is met between 0 and itself
    reached = lambda b: sum(b**k for k in range(n)) / sum(b**k for k in range(n - 1))
    a, b = 0.0, ratio
    for _ in range(200):
        middle = (a + b) / 2
        a, b = (middle, b) if reached(middle) < ratio else (a, middle)
    share = lambda k: sum(b**i for i in range(k))  # noqa: E731  (b^k - 1) / (b - 1)
    return [low * share(n) / share(k) for k in range(1, n + 1)]
