"""Mixing of sources to target weights, with DataFrame functions alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, load, staged, unused

#: Most sources whose targets are broadcast (a source is a short name); beyond it the join is salted.
BROADCAST_SOURCES = 10_000
SALTS = 32


def words(text: Column) -> Column:
    return F.when(text.isNull(), F.lit(0)).otherwise(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))).cast("long")


def targets(sized: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row (source, source_size, target) for each source of sized(source, size).

    Sources take the weights in code-point order (null last), repeating. They share `share` times all sizes by weight;
    no target exceeds `most` times its source's size. What is above goes to the others by weight, until none is above:
    with sources in the order of limit / weight those at their limit stand in front, and the level that the others
    share is the greatest over all ways to cut that order. Sources without words get 0.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(ranked) - 1) % len(weights) + 1).cast("int"))
    limited = by_source.select("source", "source_size", weight.alias("w"), (F.col("source_size") * float(most)).alias("most"))
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum(F.col("source_size") * float(share)).over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    heavy = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    levelled = limited.withColumn("level", left / heavy).withColumn("level", F.max("level").over(everything))
    return levelled.select("source", "source_size", F.least(F.col("level") * F.col("w"), F.col("most")).alias("target"))


def chance(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) that the id and the seed decide: the first 48 bits of an MD5."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / float(1 << 48)


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 42) -> tuple[DataFrame, dict[str, str]]:
    """docs with size, source_size, target and copies; the second value maps these four to the names they got.

    A document of a source with repetition rate r = target / source_size gets floor(r) copies and one more where a number
    hashed from its id is under the fraction. Null texts have size 0; null sources are one source; rows with one id
    decide alike; an empty table gives an empty one. Clashing columns of docs are kept, ours then start with "_".
    """
    size, source_size, target, copies, salt, key = unused(docs, "size", "source_size", "target", "copies", "salt", "mix_source")
    sized = docs.withColumn(size, words(F.col("text")))
    goal = staged(targets(sized.select("source", F.col(size).alias("size")), weights, share, most), "mix-targets")
    goal = goal.select(F.col("source").alias(key), F.col("source_size").alias(source_size), F.col("target").alias(target))
    if goal.count() <= BROADCAST_SOURCES:
        joined = sized.join(F.broadcast(goal), sized["source"].eqNullSafe(goal[key]))
    else:
        spread = goal.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        sized = sized.withColumn(salt, F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
        joined = sized.join(spread, (sized[salt] == spread[salt]) & sized["source"].eqNullSafe(spread[key])).drop(salt)
    rate = F.when(F.col(source_size) > 0, F.col(target) / F.col(source_size)).otherwise(0.0)
    extra = (chance(F.col("doc_id"), seed) < rate - F.floor(rate)).cast("long")
    return joined.drop(key).withColumn(copies, F.floor(rate) + extra), {"size": size, "source_size": source_size, "target": target, "copies": copies}


def emit(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix: each as many times as it has copies, with the columns of docs, whatever their names.

    Null texts have no words and are copied as their source's rate says; rows that share an id are copied alike; a source without words
    has the rate 0, so its rows go; an empty table gives an empty one.
    """
    mixed, names = mix(docs, **options)
    n = F.col(names["copies"]).cast("int")
    (copy,) = unused(mixed, "copy")
    return mixed.filter(n > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), n))).select(*[docs_column(c) for c in docs.columns])


def docs_column(name: str) -> Column:
    return F.col(f"`{name}`")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target and the words that the mix takes of each document."""
    mixed, n = mix(load(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", n["size"], n["source_size"], n["target"], (F.col(n["size"]) * F.col(n["copies"])).alias("taken"))


OP8_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS BIGINT) AS size
  FROM documents),
by_source AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT source, source_size, CAST([3, 1, 2][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS w,
         source_size * 2.0::DOUBLE AS most
  FROM by_source),
levels AS (
  SELECT *, (sum(source_size * 1.5::DOUBLE) OVER () - coalesce(sum(most) OVER before, 0))
          / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level
  FROM weighed
  WINDOW before AS (ORDER BY most / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goal AS (SELECT source, source_size, least(max(level) OVER () * w, most) AS target FROM levels),
rated AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
         CAST(CAST('0x' || substr(md5('42:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 12) AS BIGINT) AS DOUBLE) / 281474976710656.0::DOUBLE AS u
  FROM sized JOIN goal ON sized.source IS NOT DISTINCT FROM goal.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM rated
"""
