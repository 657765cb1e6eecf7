"""Nested weighted kernels: molecules of weighted parts, parts of weighted components with vectors, compared as matrices."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import vectors as V
from .pairs import dealt, squares, upper

#: Cells of a matrix of components by components that a task works on at once.
CELLS = 1 << 21


def part_kernel(a: Column, b: Column, sigma: float) -> Column:
    """Two parts' components array<struct<rho, v>>: the sum of rho_i rho_j exp(-|v_i - v_j|^2 / (4 sigma^2))."""
    one = lambda x, y: x["rho"] * y["rho"] * F.exp(-V.sqdist(x["v"], y["v"]) / (4 * sigma * sigma))
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + F.aggregate(b, F.lit(0.0), lambda t, y: t + one(x, y)))


def normalised(parts: DataFrame, sigma: float) -> DataFrame:
    """parts(id, part, rho, comps) with comps scaled so that each part's kernel with itself is 1 (no self-kernel: left out)."""
    own = parts.withColumn("own", part_kernel(F.col("comps"), F.col("comps"), sigma)).filter("own > 0")
    scaled = F.transform("comps", lambda c: F.struct((c["rho"] / F.sqrt("own")).alias("rho"), c["v"].alias("v")))
    return own.withColumn("comps", scaled).drop("own")


class Molecules:
    """Molecules as arrays: rho and first part of each, rho and first component of each part, rho and vector (by widths) of each component."""

    def __init__(self, ids: np.ndarray, nested: pa.Array, widths: np.ndarray):
        parts = nested.flatten()
        comps = parts.field("comps").flatten()
        self.ids = ids
        self.parts = np.append(0, np.cumsum(np.diff(nested.offsets.to_numpy())))
        self.comps = np.append(0, np.cumsum(np.diff(parts.field("comps").offsets.to_numpy())))
        self.rho = parts.field("rho").to_numpy(zero_copy_only=False).astype(float)
        self.weight = comps.field("rho").to_numpy(zero_copy_only=False).astype(float)
        flat = comps.field("v").flatten().to_numpy(zero_copy_only=False).astype(float)
        self.v = (flat.reshape(len(self.weight), -1) if len(self.weight) else np.zeros((0, len(widths)))) / widths

    def chunks(self, most: int) -> Iterator[tuple[slice, slice, slice]]:
        """Runs of molecules with about `most` components: which molecules, parts and components."""
        ends, a = self.comps[self.parts], 0
        while a < len(self.ids):
            b = max(a + 1, int(np.searchsorted(ends, ends[a] + most, side="right")) - 1)
            yield slice(a, b), slice(self.parts[a], self.parts[b]), slice(ends[a], ends[b])
            a = b

    def own(self, single: bool) -> tuple[np.ndarray, np.ndarray]:
        """Each part's kernel with itself, and its slopes (see sums())."""
        k, slopes = np.zeros(len(self.rho)), np.zeros((len(self.rho), 1 if single else self.v.shape[1]))
        for p, (a, b) in enumerate(zip(self.comps[:-1], self.comps[1:], strict=True)):
            if b > a:
                found = sums(self.v[a:b], self.weight[a:b], np.array([0]), self.v[a:b], self.weight[a:b], np.array([0]), single)
                k[p], slopes[p] = found[0][0, 0], [s[0, 0] for s in found[1]]
        return k, slopes


def sums(a: np.ndarray, wa: np.ndarray, starts_a: np.ndarray, b: np.ndarray, wb: np.ndarray, starts_b: np.ndarray, single: bool) -> tuple[np.ndarray, list[np.ndarray]]:
    """Of components by widths, with weights: sums over parts (which start where) of exp(-d / 4), and of its slopes times the widths: by each
    component's width, or by one for all."""
    over = lambda m: np.add.reduceat(np.add.reduceat(m, starts_a, axis=0), starts_b, axis=1)
    d = squares(a, b)
    e = np.outer(wa, wb) * np.exp(-d / 4)
    by = (d,) if single else ((a[:, c, None] - b[:, c]) ** 2 for c in range(a.shape[1]))
    return over(e), [over(e * x / 2) for x in by]


def filled_in(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which parts have components, and where these start."""
    some = np.flatnonzero(np.diff(starts))
    return some, starts[some] - starts[0]


def compared(x: Molecules, y: Molecules, widths: np.ndarray, width: float | None, normalise: bool, single: bool, keep: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]]:
    """Numbers of molecules of x and y, kernels, slopes by widths, and slopes by `width` of the kept pairs, in pieces."""
    own = [m.own(single) if normalise else None for m in (x, y)]
    most = int(CELLS**0.5)
    for mx, px, cx in x.chunks(most):
        for my, py, cy in y.chunks(most):
            if not keep[mx, my].any():
                continue
            shape = px.stop - px.start, py.stop - py.start
            k, slopes = np.zeros(shape), [np.zeros(shape) for _ in widths]
            (some_x, at_x), (some_y, at_y) = filled_in(x.comps[px.start : px.stop + 1]), filled_in(y.comps[py.start : py.stop + 1])
            if len(some_x) and len(some_y):
                found = sums(x.v[cx], x.weight[cx], at_x, y.v[cy], y.weight[cy], at_y, single)
                k[np.ix_(some_x, some_y)] = found[0]
                for s, f, w in zip(slopes, found[1], widths, strict=True):
                    s[np.ix_(some_x, some_y)] = f / w
            rho = np.outer(x.rho[px], y.rho[py])
            if normalise:
                (kx, sx), (ky, sy) = (own[0][0][px], own[0][1][px]), (own[1][0][py], own[1][1][py])
                rho = rho * np.outer(kx > 0, ky > 0)
                kx, ky = np.where(kx > 0, kx, 1.0), np.where(ky > 0, ky, 1.0)
                root = np.sqrt(np.outer(kx, ky))
                k = k / root
                slopes = [s / root - k / 2 * ((sx[:, c] / w / kx)[:, None] + sy[:, c] / w / ky) for c, (s, w) in enumerate(zip(slopes, widths, strict=True))]
            by_width = np.zeros(shape)
            if width is not None:
                by_width = rho * np.exp(-(1 - k) / width**2) * 2 * (1 - k) / width**3
                k = np.exp(-(1 - k) / width**2)
                slopes = [k * s / width**2 for s in slopes]
            at, to = np.nonzero(keep[mx, my])
            first_x, first_y = x.parts[mx.start : mx.stop + 1] - px.start, y.parts[my.start : my.stop + 1] - py.start
            total = lambda m: np.add.reduceat(np.add.reduceat(m, first_x[:-1], axis=0), first_y[:-1], axis=1)[at, to]  # noqa: B023, E731
            yield at + mx.start, to + my.start, total(rho * k), [total(rho * s) for s in slopes], total(by_width)


def molecule_kernel(parts: DataFrame, sigma: float | Sequence[float], blocks: int, width: float | None = None, slope: bool = False, normalise: bool = False) -> DataFrame:
    """(i, j, k[, dk[, dwidth]]) for i <= j: the sum over parts of both of rho rho' times the part kernel, or its Gaussian of width `width`.

    parts(id, part, rho, comps array<struct<rho, v>>), ids distinct numbers or texts; the part kernel is the sum of rho_i rho_j exp(-|v_i - v_j|^2 /
    (4 sigma^2)). With `normalise` it is divided by the root of both parts' own kernels (parts without any take no part), else parts are taken as they
    are, as normalised() leaves them. sigma may be a list, a width for each component of v. dk is the derivative by sigma (a list: by each), through
    the normalisation where there is one; dwidth, with a width, that by it. A molecule's parts travel as one array, since it has few; a task
    compares two blocks of molecules, in pieces of their components.
    """
    single = isinstance(sigma, (int, float))
    widths = np.array([sigma] if single else list(sigma), float)
    kind = parts.schema["id"].dataType.simpleString()
    schema = f"i {kind}, j {kind}, k double" + (f", dk {'double' if single else 'array<double>'}" if slope else "") + (", dwidth double" if slope and width is not None else "")
    empty = to_arrow_schema(StructType.fromDDL(schema)).empty_table()
    plain = F.transform("comps", lambda c: F.struct(c["rho"].cast("double").alias("rho"), c["v"].cast("array<double>").alias("v"))).alias("comps")
    grouped = parts.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("part", "rho", plain))).alias("x"))
    rows = grouped.withColumn("own", dealt(grouped, "id", blocks))
    # each side's columns have names of their own, as they are of one table
    ls = rows.select(F.col("id").alias("i"), F.col("x").alias("a"), F.col("own").alias("p"), F.explode(F.sequence(F.col("own"), F.lit(blocks - 1))).alias("q"))
    rs = rows.select(F.col("id").alias("j"), F.col("x").alias("b"), F.explode(F.sequence(F.lit(0), F.col("own"))).alias("p"), F.col("own").alias("q"))

    def work(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return empty
        x, y = (Molecules(t[i].to_numpy(), t[m].combine_chunks(), widths) for t, i, m in ((a, "i", "a"), (b, "j", "b")))
        keep = upper(x.ids, y.ids, key[0].as_py() == key[1].as_py(), True)
        out = [empty]
        for at, to, k, slopes, by_width in compared(x, y, widths, width, normalise, single, keep):
            i, j = x.ids[at], y.ids[to]
            swap = i > j
            columns = [np.where(swap, j, i), np.where(swap, i, j), k]
            if slope:
                columns.append(slopes[0] if single else pa.array(list(np.stack(slopes, axis=1)), pa.list_(pa.float64())))
                columns += [by_width] if width is not None else []
            out.append(pa.table([pa.array(c, f.type) for c, f in zip(columns, empty.schema, strict=True)], schema=empty.schema))
        return pa.concat_tables(out)

    return ls.groupBy("p", "q").cogroup(rs.groupBy("p", "q")).applyInArrow(work, schema)


def global_gaussian(entries: DataFrame, width: float) -> DataFrame:
    """(i, j, k) of molecule_kernel's entries: exp(-(1 - c) / width^2), where c is the entry normalised by both molecules' own."""
    own = entries.filter("i = j").select(F.col("i").alias("id"), F.col("k").alias("own"))
    both = entries.join(own.toDF("i", "ki"), "i").join(own.toDF("j", "kj"), "j")
    return both.select("i", "j", F.exp(-(1 - F.col("k") / F.sqrt(F.col("ki") * F.col("kj"))) / (width * width)).alias("k"))
