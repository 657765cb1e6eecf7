"""Helpers that the corpus operators share."""

from __future__ import annotations

import os
import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of words and chunks up to which memos keep them, so that a memo bounded in entries is bounded in bytes.
REMEMBERED = 64
#: Java pattern of a word: what stands between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, set here only where it is unset (local runs)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="kerntrail-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def mounted(path: str) -> str:
    """The path as the operating system sees it; the shared folder must be mounted where it is memory-mapped."""
    parts = urlparse(path)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"{path} is not a mounted folder; memory-mapped models need one")
    return parts.path


def staged(df: DataFrame, label: str) -> DataFrame:
    """df, written to the shared folder and read again: cuts the lineage, and survives a lost executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def new_folder(spark: SparkSession, label: str) -> str:
    """A new folder in the shared one, as the operating system sees it."""
    path = f"{mounted(shared_dir(spark))}/{label}-{uuid.uuid4().hex}"
    os.makedirs(path)
    return path


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fold(doc_id, modulus: int):
    """crc32 of the id as text, modulo; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % F.lit(modulus)


#: crc32(doc_id as text) of `documents` in SQL, as tables crc_table and folds(doc_id, crc): the table of all bytes, then a reduction over characters.
FOLD_SQL = """
crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t),
folds AS (
  SELECT doc_id, xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
                                 lambda a, b: xor(t[1 + (xor(a, b) & 255)], a >> 8)), 4294967295) AS crc
  FROM (SELECT DISTINCT doc_id FROM documents), crc_table)"""


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores in front where df has such columns."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out
