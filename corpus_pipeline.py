"""A corpus pipeline: five stages over documents, each written as Parquet and read again for the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerntrail.llm.common import fold, load, shared_dir
from kerntrail.llm.decontamination import decontaminate
from kerntrail.llm.language import fit, keep_known
from kerntrail.llm.mixing import emit
from kerntrail.llm.sharding import reshard
from kerntrail.llm.simhash import deduplicate


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known, with their columns; the classifier learns from three quarters of them.

    Null texts and texts without letters go, repeated rows stay, an empty table gives an empty one.
    """
    return keep_known(docs, fit(docs, fold(F.col("doc_id"), 4) != 2))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component, with its columns.

    Of ties the least id stays, null ids last, and of rows that share an id the one with the least hash of its text; null and
    empty texts are one component; an empty table gives an empty one.
    """
    return deduplicate(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark doesn't contaminate, with their columns.

    Each row is judged by its own text, so null and repeated ids don't matter; null and empty texts stay.
    """
    return decontaminate(docs, load(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the mix of sources, repeated as their rates say, with their columns.

    Null sources are one source; rows that share an id are taken equally often; a source without words has the rate 0.
    """
    return emit(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their place in 40 shards of nearly equal size: their columns and size, old_shard, shard and slot.

    Null texts have 16 bytes, repeated rows slots of their own, and an empty table gives an empty one.
    """
    return reshard(docs)[0]


STAGES = [
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]
#: SQL can express neither the classifier nor the flow.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
