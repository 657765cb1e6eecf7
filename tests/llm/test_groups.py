"""Groups of equal texts and repeated rows: kept together where they fit, and no burden where they are many."""

import hashlib
import time

from pyspark.sql import functions as F

from kerntrail.llm import registry, repeats, sharding


def test_equal_texts_stay_together_unless_they_exceed_a_shard(spark):
    """Copies of one text have three shards' bytes; those of others up to most of a shard; blocks are few, so that all share them."""
    rows = [(k, "heavy " * 20) for k in range(1500)]
    rows += [(2000 + 10 * k + j, f"group {k} " * 12) for k in range(30) for j in range(2 + k)]
    rows += [(4000 + j, "nearly a shard " * 8) for j in range(350)]
    rows += [(9000 + k, f"single {k}") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    placed, n = sharding.reshard(docs, shards=5, old_shards=2, blocks=4)
    found = placed.toPandas()
    assert sorted(found.doc_id) == sorted(r[0] for r in rows)
    apart = found.groupby("text")[n["shard"]].nunique()
    total = found[n["size"]].sum()
    for text, many in apart.items():
        own = found[found.text == text]
        assert many == 1 or own[n["size"]].sum() * 5 > total
    assert apart["heavy " * 20] > 1
    sizes = found.groupby(n["shard"])[n["size"]].sum()
    assert len(sizes) == 5 and sizes.max() < 1.05 * sizes.min()
    assert all(sorted(g[n["slot"]]) == list(range(len(g))) for _, g in found.groupby(n["shard"]))


def test_the_query_splits_no_text(spark):
    found = registry.queries()["op7_sharding"](spark, "/root/testdata/sf0.01")
    assert found.groupBy("size", "text_crc32").agg(F.count_distinct("shard").alias("n")).filter("n > 1").count() == 0


def test_many_equal_rows(spark):
    """Thousands of equal rows that share a passage with two others: all theirs goes, and it takes no longer for their number."""
    text = hashlib.sha512(b"a").hexdigest() * 3 + "".join(hashlib.sha256(bytes([k])).hexdigest() for k in range(10))
    rows = [(1, "x" + text[300:700]), (2, "y" + text[300:700] + "z"), (3, "alone")]
    same = spark.range(10_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit(text).alias("text"))
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionAll(same).repartition(4)
    began = time.time()
    got = repeats.remove_repeats(docs).groupBy("doc_id", "n_bytes", "n_removed", F.size("spans").alias("n")).count().collect()
    assert time.time() - began < 60
    assert {tuple(r) for r in got} == {(1, 401, 400, 1, 1), (2, 402, 400, 1, 1), (3, 5, 0, 0, 1), (7, len(text), len(text), 1, 10_000)}
