"""Kernel ridge regression over landmarks, for tables too long for exact.py: one pass sums normal equations, which stay as small as the landmarks are few.

With every training row a landmark this is kernel ridge regression itself: (K K + s K) b = K y has the solution of
(K + s I) b = y. With fewer it is its projection on the landmarks' kernels, and the work grows in proportion to the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pairs import kernel_block

#: Landmarks, unless a caller asks for another number; the driver holds matrices of this size only.
LANDMARKS = 256
ROWS = 2048
#: Tasks' sums that are added together on the first level, at most, are a part in so many of all.
TREE = 64


def landmarks(train: DataFrame, most: int = LANDMARKS) -> np.ndarray:
    """The rows of train(id, x) with the least hashes of their ids."""
    rows = train.orderBy(F.xxhash64("id"), "id").limit(most).select("x").toArrow()["x"].to_pylist()
    return np.array(rows, float)


def vectors(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), float) if len(column) else np.zeros((0, 0))


def normal_equations(train: DataFrame, marks: np.ndarray, name: str, sigma: float) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each bucket of train(x, y array, bucket): per quantity its matrix and right side, over rows whose label isn't NULL.

    Features are the kernels with the landmarks and a constant, the mean's place. Tasks emit a matrix of sums for each bucket and
    quantity; these are added by a tree of two levels, so that the driver gets buckets x quantities matrices.
    """
    m = len(marks) + 1

    def emitted(sums: dict[tuple[int, int], np.ndarray]) -> Iterator[pa.RecordBatch]:
        for (b, q), s in sums.items():
            yield pa.record_batch([pa.array([b], pa.int32()), pa.array([q], pa.int32()), pa.array([np.ascontiguousarray(s).tobytes()], pa.binary())], ["bucket", "quantity", "sums"])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                phi = np.column_stack([kernel_block(vectors(part["x"]), marks, name, sigma), np.ones(part.num_rows)])
                y = np.array([[np.nan if v is None else v for v in row] for row in part["y"].to_pylist()], float)
                bucket = part["bucket"].to_numpy()
                for b in np.unique(bucket):
                    for q in range(y.shape[1]):
                        own = (bucket == b) & ~np.isnan(y[:, q])
                        both = np.column_stack([phi[own], y[own, q]])
                        sums[int(b), q] = sums.get((int(b), q), 0) + phi[own].T @ both
        yield from emitted(sums)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for b, q, s in zip(batch["bucket"].to_pylist(), batch["quantity"].to_pylist(), batch["sums"], strict=True):
                sums[b, q] = sums.get((b, q), 0) + np.frombuffer(s.as_py())
        yield from emitted(sums)

    schema = "bucket int, quantity int, sums binary"
    parts = train.select("x", "y", F.col("bucket").cast("int").alias("bucket")).mapInArrow(partial, schema)
    salted = parts.withColumn("salt", F.spark_partition_id() % TREE).repartition("bucket", "quantity", "salt").drop("salt").mapInArrow(added, schema)
    rows = salted.repartition("bucket", "quantity").mapInArrow(added, schema).collect()
    quantities = max((r["quantity"] for r in rows), default=-1) + 1
    out: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for r in rows:
        s = np.frombuffer(r["sums"]).reshape(m, m + 1)
        a, b = out.setdefault(r["bucket"], (np.zeros((quantities, m, m)), np.zeros((quantities, m))))
        a[r["quantity"]], b[r["quantity"]] = s[:, :-1], s[:, -1]
    return out


def solve(equations: tuple[np.ndarray, np.ndarray], marks: np.ndarray, name: str, sigma: float, ridge: float) -> np.ndarray:
    """Coefficients (quantity x landmarks and constant); the constant isn't penalised."""
    penalty = np.zeros((len(marks) + 1,) * 2)
    penalty[:-1, :-1] = ridge * kernel_block(marks, marks, name, sigma)
    a, b = equations
    jitter = 1e-10 * np.eye(len(penalty))
    return np.stack([np.linalg.solve(x + penalty + jitter * max(np.trace(x), 1.0) / len(penalty), y) for x, y in zip(a, b, strict=True)])


def fit(train: DataFrame, sigma: float, ridge: float, name: str = "gaussian", most: int = LANDMARKS) -> dict:
    """A model from train(id, x, y array); NULL labels leave a row out for that quantity only."""
    marks = landmarks(train, most)
    equations = normal_equations(train.withColumn("bucket", F.lit(0)), marks, name, sigma)
    return {"marks": marks, "name": name, "sigma": sigma, "coefficients": [solve(equations[0], marks, name, sigma, ridge)]}


def predict(rows: DataFrame, model: dict, keep: list[str]) -> DataFrame:
    """rows(x, ...) -> the columns of keep and `prediction`: an array of arrays, by model of the set and quantity."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema.fields) + ", prediction array<array<double>>"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                phi = np.column_stack([kernel_block(vectors(part["x"]), m["marks"], m["name"], m["sigma"]), np.ones(part.num_rows)])
                found = np.stack([phi @ c.T for c in m["coefficients"]], axis=1)
                yield pa.record_batch([*[part[c] for c in keep], pa.array(found.tolist(), pa.list_(pa.list_(pa.float64())))], [*keep, "prediction"])

    return rows.select(*dict.fromkeys([*keep, "x"])).mapInArrow(work, schema)


def fold_errors(train: DataFrame, fold: Column, sigma: float, ridges: list[float], name: str = "gaussian", most: int = LANDMARKS) -> DataFrame:
    """(ridge, mae, mse) over rows left out: each fold's rows are predicted from all others.

    One pass sums the equations of each fold; all less a fold's own are those of its training rows, for any ridge.
    """
    rows = train.withColumn("bucket", fold.cast("int"))
    marks = landmarks(train, most)
    equations = normal_equations(rows, marks, name, sigma)
    folds = sorted(equations)
    every = tuple(sum(equations[f][k] for f in folds) for k in (0, 1))
    models = [solve(tuple(every[k] - equations[f][k] for k in (0, 1)), marks, name, sigma, r) for r in ridges for f in folds]
    found = predict(rows, {"marks": marks, "name": name, "sigma": sigma, "coefficients": models}, ["bucket", "y"])
    place = F.array_position(F.array(*[F.lit(f) for f in folds]), F.col("bucket")).cast("int")
    of = lambda k: F.element_at("prediction", F.lit(k * len(folds)) + place)[0] - F.col("y")[0]
    errors = found.select(F.explode(F.array(*[F.struct(F.lit(float(r)).alias("ridge"), of(k).alias("e")) for k, r in enumerate(ridges)])).alias("s"))
    return errors.groupBy("s.ridge").agg(F.avg(F.abs("s.e")).alias("mae"), F.avg(F.col("s.e") * F.col("s.e")).alias("mse"))


def search(train: DataFrame, fold: Column, sigmas: list[float], ridges: list[float], name: str = "gaussian", most: int = LANDMARKS) -> DataFrame:
    """fold_errors for each width, as (sigma, ridge, mae, mse)."""
    out = None
    for sigma in sigmas:
        part = fold_errors(train, fold, sigma, ridges, name, most).select(F.lit(float(sigma)).alias("sigma"), "ridge", "mae", "mse")
        out = part if out is None else out.unionByName(part)
    return out


def refine(train: DataFrame, fold: Column, sigma: float, low: float, high: float, rounds: int = 3, name: str = "gaussian", most: int = LANDMARKS) -> DataFrame:
    """(round, ridge, mse, slope): in each round five ridges with equal ratios are tried in one pass, then the range narrows around the best.

    slope is the central difference of the error by the ridge's logarithm, one-sided at an end of the range.
    """
    out = []
    for n in range(rounds):
        tried = [low * (high / low) ** (k / 4) for k in range(5)]
        found = {r["ridge"]: r["mse"] for r in fold_errors(train, fold, sigma, tried, name, most).collect()}
        errors = [found[r] for r in tried]
        best = min(range(5), key=lambda k: (errors[k], k))
        a, b = max(0, best - 1), min(4, best + 1)
        slope = (errors[b] - errors[a]) / float(np.log(tried[b] / tried[a]))
        out.append((n, tried[best], errors[best], slope))
        low, high = tried[a], tried[b]
    return train.sparkSession.createDataFrame(out, "round int, ridge double, mse double, slope double")
