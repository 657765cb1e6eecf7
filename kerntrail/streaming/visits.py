"""Structured Streaming over a log of visits: counts, windows, best values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..storage import new_path


def visit_counts(stream: DataFrame, key: str = "key") -> DataFrame:
    """Visits and the least value of each state so far; the state holds a row for each key."""
    return stream.groupBy(key).agg(F.count(F.lit(1)).alias("visits"), F.min("f").alias("best"))


def windowed_counts(stream: DataFrame, time: str, width: str, late: str, key: str = "key") -> DataFrame:
    """Visits by window of time. Windows that the watermark has passed leave the state, and rows that fall in them don't count any more."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), key).agg(F.count(F.lit(1)).alias("visits")).select(F.col("w.start").alias("start"), key, "visits")


def run_once(spark: SparkSession, out: DataFrame, label: str, keys: list[str], folder: str | None = None) -> DataFrame:
    """Runs a streaming aggregation over all that is there now; gives the last value of each of its keys.

    Every batch appends the rows that it changed to a Parquet table in the shared folder, beside the query's checkpoint, so
    nothing passes through the driver and a run that was broken off goes on where it stopped when it is given the same folder.
    """
    folder = folder or new_path(spark, label)

    def append(batch: DataFrame, number: int) -> None:
        # a batch that is run again writes its own part again
        batch.write.mode("overwrite").parquet(f"{folder}/changes/batch={number}")

    query = out.writeStream.outputMode("update").foreachBatch(append).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    changes = spark.read.option("basePath", f"{folder}/changes").schema(StructType([*out.schema.fields, StructField("batch", LongType())])).parquet(f"{folder}/changes")
    last = F.max_by(F.struct(*[c for c in out.columns if c not in keys]), "batch").alias("last")
    return changes.groupBy(*keys).agg(last).select(*[c if c in keys else F.col(f"last.{c}").alias(c) for c in out.columns])
