"""Column builders over array columns: distances, kernels, scaling, potentials. All stay inside Spark's expressions."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v)


def zipped(a: Column, b: Column, f: Callable[[Column, Column], Column]) -> Column:
    return total(F.zip_with(a, b, f))


def l1(a: Column, b: Column, w: Column | None = None) -> Column:
    """Sum of |a - b|, each term times its weight if there are weights."""
    terms = F.zip_with(a, b, lambda x, y: F.abs(x - y))
    return total(terms if w is None else F.zip_with(terms, w, lambda t, v: t * v))


def sqdist(a: Column, b: Column) -> Column:
    return zipped(a, b, lambda x, y: (x - y) * (x - y))


def half_l2(a: Column, b: Column, w: Column) -> Column:
    """Half the weighted squared distance."""
    return total(F.zip_with(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), w, lambda t, v: t * v)) / 2


def dot(a: Column, b: Column) -> Column:
    return zipped(a, b, lambda x, y: x * y)


def norm(x: Column) -> Column:
    return F.sqrt(total(F.transform(x, lambda v: v * v)))


def doubles(x: Column) -> Column:
    return F.transform(x, lambda v: v.cast("double"))


def gaussian(a: Column, b: Column, sigma: float) -> Column:
    return F.exp(-sqdist(a, b) / (2 * sigma * sigma))


def laplacian(a: Column, b: Column, sigma: float) -> Column:
    return F.exp(-l1(a, b) / sigma)


def gaussian_slope(a: Column, b: Column, sigma: float) -> Column:
    """The Gaussian kernel's derivative by sigma."""
    return gaussian(a, b, sigma) * sqdist(a, b) / sigma**3


def laplacian_slope(a: Column, b: Column, sigma: float) -> Column:
    """The Laplacian kernel's derivative by sigma (positive: a wider kernel is nearer 1)."""
    return laplacian(a, b, sigma) * l1(a, b) / sigma**2


#: By name: the kernel and its derivative. Own ones are any functions of two array columns and a width.
KERNELS = {"gaussian": (gaussian, gaussian_slope), "laplacian": (laplacian, laplacian_slope)}


def scaled(v: Column, low: Column, high: Column, to: tuple[float, float] = (0.0, 1.0)) -> Column:
    """From [low, high] to the target range; a range without width goes to its start."""
    width = high - low
    return F.lit(to[0]) + F.when(width == 0, 0.0).otherwise((v - low) * (to[1] - to[0]) / width)


def rescaled(v: Column, low: Column, high: Column, to: tuple[float, float] = (0.0, 1.0)) -> Column:
    """The inverse of scaled."""
    return low + (v - to[0]) * (high - low) / (to[1] - to[0])


def padded(x: Column, n: int) -> Column:
    """Cut or filled with zeros to n components."""
    return F.slice(F.concat(x, F.array_repeat(F.lit(0.0), n)), 1, n)


def upper_triangle(rows: Column, diagonal: bool = True) -> Column:
    """The upper triangle of a square matrix, row by row."""
    skip = 1 if diagonal else 2
    return F.flatten(F.transform(rows, lambda r, i: F.slice(r, i + skip, F.greatest(F.size(r) - i - (skip - 1), F.lit(0)))))


def sorted_by_norm(rows: Column, descending: bool = False) -> Column:
    """The rows of a matrix in the order of their norms; equal ones stay in order."""
    keyed = F.array_sort(F.transform(rows, lambda r, i: F.struct((-norm(r) if descending else norm(r)).alias("n"), i.alias("i"), r.alias("r"))))
    return F.transform(keyed, lambda s: s["r"])


def lennard_jones(d: Column, epsilon: float, sigma: float) -> Column:
    s6 = F.pow(F.lit(sigma) / d, 6)
    return 4 * epsilon * (s6 * s6 - s6)


def harmonic(d: Column, epsilon: float, sigma: float, gamma: float) -> Column:
    """A harmonic well with a flat bottom between gamma and sigma, epsilon deep."""
    beyond = F.when(d < gamma, gamma - d).when(d > sigma, d - sigma).otherwise(0.0)
    return beyond * beyond - epsilon


def sharp_parabola(d: Column, epsilon: float, sigma: float) -> Column:
    return 20 * (d - sigma) * (d - sigma) - epsilon


def flat_parabola(d: Column, epsilon: float, sigma: float, gamma: float) -> Column:
    """-epsilon between gamma and sigma, shallow parabolas outside."""
    return F.when(d < gamma, 0.05 * (d - gamma) * (d - gamma) - epsilon).when(d > sigma, 0.05 * (d - sigma) * (d - sigma) - epsilon).otherwise(-epsilon)


def buckingham(d: Column, epsilon: float, sigma: float, gamma: float) -> Column:
    return epsilon * F.exp(-sigma * d) - gamma / F.pow(d, 6)


def exponential(d: Column, epsilon: float, sigma: float) -> Column:
    return epsilon * F.exp(-sigma * d)


def double_well(d: Column, epsilon: float, sigma: float, gamma: float) -> Column:
    """Two equal minima, at sigma - gamma and sigma + gamma, epsilon deep."""
    z = (d - sigma) / gamma
    return epsilon * ((z * z - 1) * (z * z - 1) - 1)


def logistic(x: Column) -> Column:
    """1 / (1 + exp(x)): the chance of a step up by x."""
    return 1 / (1 + F.exp(x))


def accepted(beta: Column, old: Column, new: Column, balance: Column, uniform: Column) -> Column:
    """Metropolis: no step to NULL; without beta only downwards; else always downwards and sometimes up.

    The change is beta (new - old) + balance; an Exp(1) number from the uniform one must exceed it.
    """
    change = F.coalesce(beta, F.lit(1.0)) * (new - old) + balance
    return F.when(new.isNull(), False).when(beta.isNull(), new < old).otherwise((change <= 0) | (-F.log(1 - uniform) > change))


def bounded(value: Column, low: float | None = None, high: float | None = None) -> Column:
    """NULL outside the bounds."""
    ok = F.lit(True)
    if low is not None:
        ok = ok & (value >= low)
    if high is not None:
        ok = ok & (value <= high)
    return F.when(ok, value)


def linear_combination(terms: list[tuple[float, Column]]) -> Column:
    """NULL if any term is."""
    out = F.lit(0.0)
    for factor, column in terms:
        out = out + factor * column
    return out


def constrained(value: Column, *constraints: Column) -> Column:
    """NULL where a constraint fails (or is unknown)."""
    out = value
    for ok in constraints:
        out = F.when(ok, out)
    return out


def symmetric_bin(x: Column, width: float) -> Column:
    """Bins of equal width around 0 with signs; 0 up to half a width."""
    k = F.floor(F.abs(x) / width - 0.5)
    return F.when(F.abs(x) < width / 2, F.lit(0)).when(x < 0, -k).otherwise(k).cast("long")


def sphere_volume(n: int, radius: float) -> float:
    """The volume of a ball in n dimensions."""
    return math.exp(n / 2 * math.log(math.pi) + n * math.log(radius) - math.lgamma(n / 2 + 1))


def even_betas(low: float, high: float, n: int) -> list[float]:
    """Inverse temperatures with equal steps between them."""
    return [low + (high - low) * k / (n - 1) for k in range(n)] if n > 1 else [low]


def even_temperatures(low: float, high: float, n: int) -> list[float]:
    """Inverse temperatures whose temperatures have equal steps."""
    return [1 / t for t in even_betas(1 / low, 1 / high, n)]


def geometric_betas(low: float, high: float, n: int) -> list[float]:
    """Inverse temperatures with equal ratios."""
    return [low * (high / low) ** (k / (n - 1)) for k in range(n)] if n > 1 else [low]


#: Nuclear charges and valences by element, and units.
CHARGE = {"H": 1, "B": 5, "C": 6, "N": 7, "O": 8, "F": 9, "Si": 14, "P": 15, "S": 16, "Cl": 17, "Br": 35, "I": 53}
VALENCES = {1: [1], 5: [3], 6: [4], 7: [3], 8: [2], 9: [1], 14: [4], 15: [3, 5], 16: [2, 4, 6], 17: [1], 35: [1], 53: [1]}
HARTREE_IN_EV, HARTREE_IN_KCAL, BOHR_IN_ANGSTROM = 27.211386245988, 627.5094740631, 0.529177210903


def lookup(table: dict, key: Column) -> Column:
    """A small fixed table as a map literal; NULL for unknown keys."""
    return F.create_map(*[F.lit(x) if not isinstance(x, list) else F.array(*map(F.lit, x)) for pair in table.items() for x in pair])[key]
