"""The best candidates of a stream: a bounded map of states' least values for each of some buckets of keys, kept by a stateful operator."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .visits import run_once

#: Parts that keys are dealt into, so that no task sees all visits; each keeps n candidates.
BUCKETS = 8
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SCHEMA = "bucket int, rank int, key string, f double"


class Best(StatefulProcessor):
    """Of a bucket's states those with the n least values, each once, ties by key.

    With an expiry a state that wasn't seen in so many steps before the bucket's last one leaves, its value with it. What drops out of a full
    list was above its greatest value, which only falls, so forgetting it loses nothing (unless states expire).
    """

    def __init__(self, n: int, expiry: int | None):
        self.n, self.expiry = n, expiry

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("best", "key string", "f double, last long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        before = {k[0]: tuple(v) for k, v in self.held.iterator()}
        now, latest = dict(before), max((last for _, last in before.values()), default=0)
        for frame in rows:
            frame = frame.dropna(subset=["f", "key"]).sort_values("step", kind="stable")
            for name, f, step in zip(frame["key"], frame["f"], frame["step"], strict=True):
                was, last = now.get(name, (float("inf"), step))
                fresh = self.expiry is None or step - last <= self.expiry
                now[name] = min(float(f), was) if fresh else float(f), max(int(step), last)
                latest = max(latest, int(step))
        left = [(f, name) for name, (f, last) in now.items() if self.expiry is None or latest - last <= self.expiry]
        best = sorted(left, key=lambda x: (x[0], x[1].encode()))[: self.n]
        kept = {name for _, name in best}
        for name in before.keys() - kept:
            self.held.removeKey((name,))
        for name in kept:
            if before.get(name) != now[name]:
                self.held.updateValue((name,), now[name])
        free = [None] * (self.n - len(best))
        names, values = [name for _, name in best] + free, [f for f, _ in best] + free
        yield pd.DataFrame({"bucket": [key[0]] * self.n, "rank": range(1, self.n + 1), "key": pd.Series(names, dtype=object), "f": pd.Series(values, dtype="float64")})

    def close(self) -> None:
        pass


def best_so_far(stream: DataFrame, n: int, expiry: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """stream(key, f, ...) -> (bucket, rank, key, f) in update mode: the whole list of each bucket that got rows, NULL in places that are free.

    expiry: steps (of a column `step`) after which a state that wasn't seen leaves its bucket's list. Null keys and values don't count. The state
    holds n rows for each bucket, whatever the number of states.
    """
    step = F.col("step").cast("long") if expiry is not None else F.lit(0).cast("long")
    dealt = stream.select(F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int").alias("bucket"), F.col("key").cast("string").alias("key"), F.col("f").cast("double").alias("f"), step.alias("step"))
    return dealt.groupBy("bucket").transformWithStateInPandas(Best(n, expiry), SCHEMA, "Update", "None")


def best_candidates(spark: SparkSession, stream: DataFrame, n: int, folder: str | None = None, expiry: int | None = None) -> DataFrame:
    """Runs over all that is there now, going on from what a run with the same folder has seen: (key, f) of the n states with the least values."""
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)  # the store that such state needs; read when the query starts
    try:
        lists = run_once(spark, best_so_far(stream, n, expiry), "best-candidates", ["bucket", "rank"], folder)
    finally:
        spark.conf.set(STORE, before)
    return lists.filter("key IS NOT NULL").orderBy("f", "key").limit(n).select("key", "f")
