"""Views of the given tables as vectors, runs and molecules, in DataFrames and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors as V


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def vector_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, x, label) of embeddings."""
    return load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), V.doubles(F.col("embedding")).alias("x"), "label")


def visit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as visits: a user is a replica, its events in time are steps, type and tens of the value name a state."""
    step = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    beta_class = F.pmod("user_id", F.lit(8)).cast("int")
    key = F.concat_ws(":", "event_type", F.floor(F.col("value") / 10).cast("string"))
    return load(spark, sf_dir, "events").select(
        F.col("user_id").alias("replica"), step.alias("step"), key.alias("key"), F.col("value").alias("f"),
        beta_class.alias("beta_class"), F.when(beta_class >= 2, 1.0 / beta_class).alias("beta"), "event_type", "event_id",
    )


def atom_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as molecules: a line is an atom, its flag the element, quantity, discount and tax its place."""
    z = F.when(F.col("l_returnflag") == "A", 6).when(F.col("l_returnflag") == "N", 7).otherwise(8)
    return load(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("graph"), F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")).alias("atom"), z.alias("z"),
        F.array(F.col("l_quantity"), 100 * F.col("l_discount"), 100 * F.col("l_tax")).alias("at"), "l_quantity", "l_extendedprice",
    )


def bond_rows(atoms: DataFrame) -> DataFrame:
    """Consecutive atoms are bonded; two nitrogens by a double bond. Atoms are counted up, so a window that they stand in already finds the next."""
    following = Window.partitionBy("graph").orderBy("atom")
    ends = atoms.filter("graph IS NOT NULL").select("graph", "atom", "z", F.lead("z").over(following).alias("zb"), F.lead("atom").over(following).alias("b")).filter("b IS NOT NULL")
    order = F.when((F.col("z") == 7) & (F.col("zb") == 7), 2).otherwise(1)
    return ends.select("graph", F.col("atom").alias("a"), (F.col("atom") + 1).alias("b"), order.alias("order"))


VECTORS = "v AS (SELECT vec_id AS id, list_transform(embedding, lambda c: CAST(c AS DOUBLE)) AS x, label FROM embeddings)"
PAIRS = VECTORS + """, p AS (
  SELECT a.id AS i, b.id AS j, pow(list_distance(a.x, b.x), 2) AS d2,
         list_sum(list_transform(list_zip(a.x, b.x), lambda t: abs(t[1] - t[2]))) AS d1
  FROM v a JOIN v b ON a.id <= b.id)"""
VISITS = """t AS (
  SELECT user_id AS replica, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step,
         event_type || ':' || CAST(CAST(floor(value / 10) AS BIGINT) AS VARCHAR) AS key, value AS f,
         CAST(user_id % 8 AS INTEGER) AS beta_class, CASE WHEN user_id % 8 >= 2 THEN 1.0::DOUBLE / (user_id % 8) END AS beta, event_type, event_id
  FROM events)"""
ATOMS = """m AS (
  SELECT l_orderkey AS graph, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS INTEGER) AS atom,
         CASE l_returnflag WHEN 'A' THEN 6 WHEN 'N' THEN 7 ELSE 8 END AS z, l_quantity, l_extendedprice,
         [l_quantity, 100 * l_discount, 100 * l_tax] AS place
  FROM lineitem),
b AS (
  SELECT a.graph, a.atom AS a, c.atom AS b, CASE WHEN a.z = 7 AND c.z = 7 THEN 2 ELSE 1 END AS "order"
  FROM m a JOIN m c ON a.graph = c.graph AND c.atom = a.atom + 1)"""
