"""All-pairs operators: blocks of rows meet by equi-joins, and a task compares two blocks at a time as matrices."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V

#: Most rows of a block, and the rows that a block has at least before the rows are dealt out further for the sake of parallel tasks.
BLOCK, LEAST = 2048, 256
#: A row is sent as often as the other side has blocks, so beyond MANY blocks these become larger, up to WIDE rows.
MANY, WIDE = 24, 16384
#: The same of the blocks of a band of within(), of which a row meets several.
BANDED = 16
#: Rows of either side that a task compares at once, and rows of results that it holds before it combines them.
TILE, HELD = 1024, 1 << 20
#: Rows of either side whose differences are taken at once.
SUBTILE = 256


def block_count(rows: int, block: int = BLOCK, parallel: int = 1) -> int:
    """Blocks of at most `block` rows (expected), or of more where there would be over MANY; more where there would be fewer pairs of blocks than parallel tasks."""
    return max(min(rows // block + 1, max(MANY, rows // WIDE + 1)), min(rows // LEAST + 1, int((2 * parallel) ** 0.5) + 1))


def pairs(left: DataFrame, right: DataFrame, blocks: tuple[int, int]) -> DataFrame:
    """left(i, a), right(j, b): all pairs as rows, for any columns' expressions. Each row goes to as many tasks as the other side has blocks."""
    m, n = blocks
    ls = left.withColumn("p", F.pmod(F.xxhash64("i"), F.lit(m)).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    rs = right.withColumn("q", F.pmod(F.xxhash64("j"), F.lit(n)).cast("int")).withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    return ls.join(rs, ["p", "q"]).drop("p", "q")


def symmetric_pairs(vectors: DataFrame, blocks: int, diagonal: bool = True) -> DataFrame:
    """vectors(id, x): the pairs (i, a, j, b) with i <= j (i < j without the diagonal) as rows, for any columns' expressions.

    A block of rows meets itself and the blocks behind it.
    """
    own = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    ls = vectors.select(F.col("id").alias("i"), F.col("x").alias("a"), own.alias("p")).withColumn("q", F.explode(F.sequence(F.col("p"), F.lit(blocks - 1))))
    rs = vectors.select(F.col("id").alias("j"), F.col("x").alias("b"), own.alias("q")).withColumn("p", F.explode(F.sequence(F.lit(0), F.col("q"))))
    met = ls.join(rs, ["p", "q"]).filter((F.col("p") < F.col("q")) | ((F.col("i") <= F.col("j")) if diagonal else (F.col("i") < F.col("j"))))
    swap = F.col("i") > F.col("j")
    side = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x)).alias(x)
    return met.select(side("i", "j"), side("a", "b"), side("j", "i"), side("b", "a"))


def mirrored(entries: DataFrame, *values: str) -> DataFrame:
    """The lower triangle added to entries (i, j, values) with i <= j."""
    return entries.unionByName(entries.filter("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), *values))


# blocks as matrices

Tile = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bool], pa.Table]
Combine = Callable[[pa.Table], pa.Table]


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Lists of one length as a matrix of doubles."""
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances by a matrix product; where it cancels digits (near rows) by differences."""
    size = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)
    d = size - 2 * (a @ b.T)
    i, j = np.nonzero(d < 1e-4 * size)
    for k in range(0, len(i), 1 << 16):
        some = slice(k, k + (1 << 16))
        d[i[some], j[some]] = ((a[i[some]] - b[j[some]]) ** 2).sum(axis=1)
    return d


def absolutes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of absolute differences, in pieces that stay in the processor's cache."""
    out = np.zeros((len(a), len(b)))
    for k in range(0, len(a), SUBTILE):
        for m in range(0, len(b), SUBTILE):
            x, y, part = a[k : k + SUBTILE], b[m : m + SUBTILE].T.copy(), out[k : k + SUBTILE, m : m + SUBTILE]
            for c in range(a.shape[1]):
                part += np.abs(x[:, c, None] - y[c])
    return out


#: By name: the distance that a kernel is a function of, the kernel and its derivative by the width. Own kernels are added here.
KERNELS: dict[str, tuple[Callable, Callable, Callable]] = {
    "gaussian": (squares, lambda d, s: np.exp(-d / (2 * s * s)), lambda d, s: np.exp(-d / (2 * s * s)) * d / s**3),
    "laplacian": (absolutes, lambda d, s: np.exp(-d / s), lambda d, s: np.exp(-d / s) * d / s**2),
}


def kernel_block(a: np.ndarray, b: np.ndarray, name: str, sigma: float) -> np.ndarray:
    if name not in KERNELS:
        raise ValueError(f"no kernel {name}")
    distance, kernel, _ = KERNELS[name]
    return kernel(distance(a, b), sigma)


def dealt(rows: DataFrame, key: str, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def packed(rows: DataFrame, key: str, x: str, by: dict[str, str]) -> DataFrame:
    """rows(key, x, by) -> a row of each group, (by, ids, xs, single): ids in order and their vectors as one matrix, in single precision if that loses nothing."""

    def pack(group: tuple, own: pa.Table) -> pa.Table:
        ids = own[key].to_numpy().astype(np.int64)
        order = np.argsort(ids, kind="stable")
        m = matrix(own[x])[order]
        with np.errstate(over="ignore"):
            short = m.astype(np.float32)
        single = bool((short == m).all())
        cell = {"ids": pa.array([ids[order].tobytes()], pa.binary()), "xs": pa.array([(short if single else m).tobytes()], pa.binary()), "single": [single]}
        return pa.table({name: pa.array([k.as_py()], k.type) for name, k in zip(by, group, strict=True)} | cell)

    schema = ", ".join(f"{name} {kind}" for name, kind in by.items())
    return rows.select(key, x, *[F.col(name).cast(kind).alias(name) for name, kind in by.items()]).groupBy(*by).applyInArrow(pack, schema + ", ids binary, xs binary, single boolean")


def unpacked(ids: bytes, xs: bytes, single: bool) -> tuple[np.ndarray, np.ndarray]:
    own = np.frombuffer(ids, np.int64)
    return own, np.frombuffer(xs, np.float32 if single else float).reshape(len(own), -1).astype(float)


def rect_tiles(left: DataFrame, right: DataFrame, tile: Tile, schema: str, blocks: tuple[int, int], combine: Combine | None = None) -> DataFrame:
    """left(i, a), right(j, b): tile(i, a, j, b, ...) of each pair of blocks, as rows of the schema.

    Null vectors take no part; all must have one length.
    """
    m, n = blocks
    ls = packed(left.filter("a IS NOT NULL").withColumn("p", dealt(left, "i", m)), "i", "a", {"p": "int"}).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    rs = packed(right.filter("b IS NOT NULL").withColumn("q", dealt(right, "j", n)), "j", "b", {"q": "int"}).withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    return met(ls, rs, tile, schema, ("p", "q"), m * n, combine)


def met(ls: DataFrame, rs: DataFrame, tile: Tile, schema: str, keys: tuple[str, ...], many: int, combine: Combine | None = None, halves: bool = False) -> DataFrame:
    """tile(...) of what packed() sides hold for each value of the keys, of which there are about `many`.

    A task has two blocks at a time and takes TILE rows of each at once, so what it holds doesn't grow with them. combine: puts the results of tiles
    of two blocks together. halves: keys that are the same block twice stand for its unordered pairs.
    """
    names = [*keys, "side", "ids", "xs", "single"]

    def found(i: np.ndarray, a: np.ndarray, j: np.ndarray, b: np.ndarray, same: bool) -> Iterator[pa.Table]:
        held, rows = [], 0
        for k in range(0, len(i), TILE):
            for m in range(k if same else 0, len(j), TILE):
                table = tile(i[k : k + TILE], a[k : k + TILE], j[m : m + TILE], b[m : m + TILE], same and k == m)
                if combine is None:
                    yield table
                    continue
                held.append(table)
                rows += table.num_rows
                if rows > HELD:
                    held = [combine(pa.concat_tables(held))]
                    rows = 0
        if held:
            yield combine(pa.concat_tables(held))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, i, a = None, None, None
        for batch in batches:
            for n in range(batch.num_rows):
                *key, side, ids, xs, single = (batch[c][n].as_py() for c in names)
                if side == 0:
                    at, (i, a) = key, unpacked(ids, xs, single)
                elif at == key:
                    j, b = unpacked(ids, xs, single)
                    for table in found(i, a, j, b, halves and key[-2] == key[-1]):
                        yield from table.to_batches()

    both = ls.withColumn("side", F.lit(0)).select(names).unionByName(rs.withColumn("side", F.lit(1)).select(names))
    # more tasks than keys, so that few have several
    return both.repartition(max(1, min(4 * many, 4096)), *keys).sortWithinPartitions(*keys, "side").mapInArrow(work, schema)


def tiles(vectors: DataFrame, tile: Tile, schema: str, blocks: int, combine: Combine | None = None) -> DataFrame:
    """vectors(id, x): tile(i, a, j, b, same) of each unordered pair of blocks, piece by piece; same: whether both are one piece of a block.

    A tile has to give each unordered pair of rows once (see upper()).
    """
    rows = packed(vectors.filter("x IS NOT NULL").select("id", "x", dealt(vectors, "id", blocks).alias("own")), "id", "x", {"own": "int"})
    ls = rows.withColumnRenamed("own", "p").withColumn("q", F.explode(F.sequence(F.col("p"), F.lit(blocks - 1))))
    rs = rows.withColumnRenamed("own", "q").withColumn("p", F.explode(F.sequence(F.lit(0), F.col("q"))))
    return met(ls, rs, tile, schema, ("p", "q"), blocks * (blocks + 1) // 2, combine, halves=True)


def summed(*keys: str) -> Combine:
    """Results of tiles whose `v` is summed by the keys."""
    return lambda table: table.group_by(list(keys), use_threads=False).aggregate([("v", "sum")]).rename_columns({"v_sum": "v"}).select([*keys, "v"])


def upper(i: np.ndarray, j: np.ndarray, same: bool, diagonal: bool) -> np.ndarray:
    """Which cells of a tile stand for a pair: all of two blocks, i <= j (or i < j) inside one."""
    if not same:
        return np.ones((len(i), len(j)), bool)
    return i[:, None] <= j if diagonal else i[:, None] < j


def cells(i: np.ndarray, j: np.ndarray, keep: np.ndarray, **values: np.ndarray) -> pa.Table:
    """The kept cells of a tile as rows (i, j, values) with the smaller id first."""
    if keep.all():
        a, b = np.repeat(i, len(j)), np.tile(j, len(i))
        return pa.table({"i": np.minimum(a, b), "j": np.maximum(a, b), **{k: v.ravel() for k, v in values.items()}})
    at, to = np.nonzero(keep)
    a, b = i[at], j[to]
    return pa.table({"i": np.minimum(a, b), "j": np.maximum(a, b), **{k: v[at, to] for k, v in values.items()}})


def kernel_entries(vectors: DataFrame, name: str, sigma: float, blocks: int, slope: bool = False, ridge: float = 0.0) -> DataFrame:
    """(i, j, k[, dk]) for i <= j of a kernel matrix; ridge is added to the diagonal."""
    distance, kernel, derivative = KERNELS[name]

    def tile(i, a, j, b, same):
        d = distance(a, b)
        k = kernel(d, sigma) + (np.where(i[:, None] == j, ridge, 0.0) if ridge else 0.0)
        return cells(i, j, upper(i, j, same, True), k=k, **({"dk": derivative(d, sigma)} if slope else {}))

    return tiles(vectors, tile, "i long, j long, k double" + (", dk double" if slope else ""), blocks)


def kernel_rect(left: DataFrame, right: DataFrame, name: str, sigma: float, blocks: tuple[int, int]) -> DataFrame:
    """left(i, a), right(j, b) -> (i, j, k)."""

    def tile(i, a, j, b, same):
        k = kernel_block(a, b, name, sigma)
        return pa.table({"i": np.repeat(i, len(j)), "j": np.tile(j, len(i)), "k": k.ravel()})

    return rect_tiles(left, right, tile, "i long, j long, k double", blocks)


def kernel_sqdist(vectors: DataFrame, name: str, sigma: float, blocks: int) -> DataFrame:
    """vectors(id, x) -> (i, j, d2) for i <= j: K_ii + K_jj - 2 K_ij, worked out with the kernel, so that nothing with a row for each pair is joined."""
    distance, kernel, _ = KERNELS[name]
    own = lambda x: np.array([kernel(distance(r[None], r[None]), sigma)[0, 0] for r in x])

    def tile(i, a, j, b, same):
        return cells(i, j, upper(i, j, same, True), d2=np.where(i[:, None] == j, 0.0, own(a)[:, None] + own(b) - 2 * kernel_block(a, b, name, sigma)))

    return tiles(vectors, tile, "i long, j long, d2 double", blocks)


def kernel_to_sqdist(entries: DataFrame) -> DataFrame:
    """K_ii + K_jj - 2 K_ij for entries (i, j, k) with i <= j."""
    diagonal = entries.filter("i = j").select(F.col("i").alias("id"), F.col("k").alias("kd"))
    joined = entries.join(diagonal.select(F.col("id").alias("i"), F.col("kd").alias("ki")), "i").join(diagonal.select(F.col("id").alias("j"), F.col("kd").alias("kj")), "j")
    return joined.select("i", "j", (F.col("ki") + F.col("kj") - 2 * F.col("k")).alias("d2"))


def nearest_k(vectors: DataFrame, k: int, blocks: int) -> DataFrame:
    """(id, rank, neighbour, d2): each row's k nearest others, ties to smaller ids.

    A task keeps k rows of each block for each row of the other; only these are ranked. Rows whose matrix product says
    that they might be among the k are compared by differences, so that equal rows are equally far.
    """

    def best(i, a, j, b, d):
        """Of each row of a its k nearest in b (without itself)."""
        own = i[:, None] == j
        d = np.where(own, np.inf, d)
        most = np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, min(k, d.shape[1]) - 1]
        slack = 1e-9 * ((a * a).sum(axis=1) + (b * b).sum(axis=1).max() + 1e-300)
        at, to = np.nonzero((d <= (most + slack)[:, None]) & ~own)
        exact = ((a[at] - b[to]) ** 2).sum(axis=1)
        order = np.lexsort((j[to], exact, at))
        at, to, exact = at[order], to[order], exact[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        some = place < k
        return i[at[some]], j[to[some]], exact[some]

    def tile(i, a, j, b, same):
        d = squares(a, b)
        found = [best(i, a, j, b, d)] + ([] if same else [best(j, b, i, a, d.T)])
        x, y, z = (np.concatenate(c) for c in zip(*found, strict=True))
        return pa.table({"id": x, "neighbour": y, "d2": z})

    def nearest_of(table: pa.Table) -> pa.Table:
        x, y, z = (table[c].to_numpy() for c in ("id", "neighbour", "d2"))
        order = np.lexsort((y, z, x))
        x, y, z = x[order], y[order], z[order]
        some = np.arange(len(x)) - np.searchsorted(x, x) < k
        return pa.table({"id": x[some], "neighbour": y[some], "d2": z[some]})

    rank = F.row_number().over(Window.partitionBy("id").orderBy("d2", "neighbour"))
    found = tiles(vectors, tile, "id long, neighbour long, d2 double", blocks, nearest_of)
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("id", "rank", "neighbour", "d2")


def nearest(vectors: DataFrame, blocks: int) -> DataFrame:
    """Each row's nearest other row (id, neighbour, d2); ties go to the smaller id."""
    return nearest_k(vectors, 1, blocks).drop("rank")


def radial_distribution(vectors: DataFrame, width: float, blocks: int) -> DataFrame:
    """(shell, n): how many pairs are between shell and shell + 1 widths apart, counted inside tasks first."""

    def tile(i, a, j, b, same):
        d = np.sqrt(squares(a, b)[upper(i, j, same, False)])
        shell, n = np.unique(np.floor(d / width).astype(np.int64), return_counts=True)
        return pa.table({"shell": shell, "n": n.astype(np.int64)})

    return tiles(vectors, tile, "shell long, n long", blocks).groupBy("shell").agg(F.sum("n").alias("n"))


def extremes(vectors: DataFrame, blocks: int) -> DataFrame:
    """The greatest L1 and Euclidean distances of any two rows, as one row (l1, l2)."""

    def tile(i, a, j, b, same):
        return pa.table({"l1": [absolutes(a, b).max()], "d2": [squares(a, b).max()]})

    greatest = lambda t: pa.table({c: [pc.max(t[c]).as_py()] for c in ("l1", "d2")})
    return tiles(vectors, tile, "l1 double, d2 double", blocks, greatest).agg(F.max("l1").alias("l1"), F.sqrt(F.max("d2")).alias("l2"))


def pivots_of(rows: DataFrame, x: str, n: int = 2) -> list[list[float]]:
    """n far rows: the one farthest from the zero vector, then each time the one whose nearest pivot is farthest (ties: any)."""
    found: list[list[float]] = []
    for _ in range(n):
        far = V.norm(F.col(x)) if not found else F.least(*[d2 for p in found for d2 in [V.sqdist(F.col(x), F.array(*map(F.lit, p)))] * 2])
        top = rows.filter(F.col(x).isNotNull()).agg(F.max_by(x, far)).first()[0]
        if top is None:
            break
        found.append(list(top))
    return found


def within(left: DataFrame, right: DataFrame, high: float, low: float = 0.0, pivots: int = 2, block: int = LEAST, ordered: bool = False) -> DataFrame:
    """left(i, a), right(j, b) -> (i, j, d): the pairs with low <= distance <= high; ordered: those with i < j.

    Distances to a pivot differ by `high` at most in such pairs, so rows meet only in the same or neighbouring bands of distances to
    each of some far pivots. A band may hold all rows (where `high` is wide), so inside bands rows meet in blocks, of which
    a band has as many as its rows need: of about `block` rows, or of more where there would be over BANDED, but not over WIDE.
    Equal rows alone, for a radius of 0, are met by their values.
    """
    if high < 0:
        raise ValueError("a distance can't be negative")
    if high == 0:
        same = left.filter("a IS NOT NULL").select("i", "a").join(right.filter("b IS NOT NULL").select("j", "b"), F.col("a") == F.col("b"))
        return same.filter(F.lit(low <= 0) & (F.lit(not ordered) | (F.col("i") < F.col("j")))).select("i", "j", F.lit(0.0).alias("d"))
    chosen = pivots_of(right, "b", pivots)
    bands = [f"band{k}" for k in range(len(chosen))]
    at = lambda x, p: F.floor(F.sqrt(V.sqdist(F.col(x), F.array(*map(F.lit, p)))) / high)
    around = lambda band: F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda s: s + band))
    ls, rs = left.filter("a IS NOT NULL").select("i", "a"), right.filter("b IS NOT NULL").select("j", "b")
    for name, p in zip(bands, chosen, strict=True):
        rs = rs.withColumn(name, at("b", p))
        ls = ls.withColumn(name, around(at("a", p)))
    if not chosen:
        return left.join(right, F.lit(False)).select("i", "j", F.lit(0.0).alias("d"))

    def counts(rows: DataFrame, name: str) -> DataFrame:
        size = F.count(F.lit(1))
        own = F.least(F.greatest(F.floor(size / BANDED), F.lit(block)), F.lit(WIDE))
        return rows.groupBy(*bands).agg((F.floor(size / own) + 1).cast("int").alias(name))

    sizes = counts(ls, "m").join(counts(rs, "n"), bands)
    by = {band: "long" for band in bands}
    ls = packed(ls.join(sizes, bands).withColumn("p", F.pmod(F.xxhash64("i"), F.col("m")).cast("int")), "i", "a", by | {"p": "int", "n": "int"}).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    rs = packed(rs.join(sizes, bands).withColumn("q", F.pmod(F.xxhash64("j"), F.col("n")).cast("int")), "j", "b", by | {"q": "int", "m": "int"}).withColumn("p", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))

    def tile(i, a, j, b, same):
        d = np.sqrt(squares(a, b))
        near = (d >= low) & (d <= high)
        at, to = np.nonzero(near & (i[:, None] < j) if ordered else near)
        return pa.table({"i": i[at], "j": j[to], "d": d[at, to]})

    return met(ls, rs, tile, "i long, j long, d double", (*bands, "p", "q"), max(BANDED**2, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
