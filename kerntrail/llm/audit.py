"""Audit of a chain of filters in every order: min-plus removal ranks over the documents' failure masks."""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, load, staged

FILTERS = "ABCDE"
#: Sums that a part's rows carry for each mask.
SUMS = ["n", "n_good", "n_toxic"]
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SYMBOLS = "[#$%&*|]"


def orders(filters: str = FILTERS) -> tuple[list[str], np.ndarray]:
    """All orders of the filters, and for each the place of every filter in it: the inverse permutations as rows."""
    names = ["".join(p) for p in permutations(filters)]
    return names, np.array([[name.index(f) for f in filters] for name in names])


def removal_ranks(masks: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The min-plus product of masks x filters (0 where it fails, else infinite) with filters x orders (places).

    Entry (m, o): the step, from 0, at which order o removes what fails the filters of mask m; the number of filters if none does.
    """
    steps = places.shape[1]
    out = np.full((len(masks), len(places)), steps)
    for f in range(steps):
        out = np.minimum(out, np.where(masks[:, f, None], places[None, :, f], steps))
    return out


def audited(sums: pd.DataFrame, filters: str = FILTERS) -> pd.DataFrame:
    """The rows of one part, from the sums of its masks: one for each order and step, zeros included."""
    names, places = orders(filters)
    k, many = len(filters), len(names)
    fails = (sums["mask"].to_numpy()[:, None] >> np.arange(k)) & 1 == 1
    weights = [sums[c].to_numpy(np.int64) for c in SUMS]
    rank = removal_ranks(fails, places)
    cell = np.arange(many) * (k + 1) + rank  # masks x orders: the cell of order and step

    def scattered(w: np.ndarray) -> np.ndarray:
        out = np.zeros(many * (k + 1), np.int64)
        np.add.at(out, cell, np.broadcast_to(w[:, None], cell.shape))
        return out.reshape(many, k + 1)[:, :k]

    removed, good, toxic = map(scattered, weights)
    of_step = np.argsort(places, axis=1)  # orders x steps: the filter there
    failing = weights[0] @ fails
    alone = weights[0] @ (fails & (fails.sum(axis=1) == 1)[:, None])
    shapley = np.zeros(k, np.int64)
    np.add.at(shapley, of_step, removed)
    columns = {
        "filter_order": np.repeat(names, k),
        "step": np.tile(np.arange(1, k + 1, dtype=np.int32), many),
        "kept": weights[0].sum() - np.cumsum(removed, axis=1),
        "removed": removed,
        "redundant": failing[of_step] - removed,
        "unique_fails": alone[of_step],
        "good_lost": good,
        "toxic_lost": toxic,
        "shapley": shapley[of_step],
    }
    return pd.DataFrame({name: np.ravel(values) for name, values in columns.items()})


def own_failures(text: Column) -> Column:
    """The mask of the filters A to D, which a text fails by itself; bit 0 is A. The text is not null."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    length = F.char_length(text)
    capitals = length - F.char_length(F.translate(text, CAPITALS, ""))
    failed = [
        F.size(words) < 100,
        F.size(F.array_distinct(words)).cast("long") * 100 < F.size(words).cast("long") * 80,
        capitals.cast("long") * 100 > length.cast("long") * 10,
        text.rlike(SYMBOLS),
    ]
    mask = F.lit(0)
    for bit, condition in enumerate(failed):
        mask = mask + F.when(condition, F.lit(1 << bit)).otherwise(F.lit(0))
    return mask


def mask_sums(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, n_good, n_toxic: how many documents of each part fail just the filters of the mask, and how many of them are labelled.

    Only ids, parts, own masks and digests of texts are shuffled, texts never. Equal rows meet as one row with their number, first
    in each task, so neither a text's copies nor a repeated id make a hot key; of a text's rows one for each part and label is left
    where the least id is found.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), own_failures(text).alias("own"))
    rows = rows.groupBy("doc_id", "part", "digest", "own").agg(F.count(F.lit(1)).alias("n"))
    known = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    flag = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("good", "toxic")]
    rows = rows.join(known, "doc_id", "left").select("doc_id", "part", "digest", "own", "n", *flag)
    # of the rows of a text and part those with its least id are apart from the rest: only they may be no copies
    sums = [F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("n_good"), F.sum(F.col("n") * F.col("toxic")).alias("n_toxic")]
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n", "good", "toxic"))).alias("least")
    unnamed = F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("unnamed")
    texts = rows.groupBy("digest", "part", "own").agg(*sums, least, unnamed)
    first = F.min("least.doc_id").over(Window.partitionBy("digest"))
    texts = texts.withColumn("is_first", F.coalesce(F.col("least.doc_id") == first, F.lit(False)))
    at = F.when(F.col("is_first"), F.col("least.n")).otherwise(F.lit(0))
    fresh = F.struct(F.col("own").alias("mask"), (at + F.col("unnamed")).alias("n"), (at * F.coalesce("least.good", F.lit(0))).alias("n_good"), (at * F.coalesce("least.toxic", F.lit(0))).alias("n_toxic"))
    copies = F.struct(
        (F.col("own") + F.lit(1 << FILTERS.index("E"))).alias("mask"),
        (F.col("n") - fresh["n"]).alias("n"),
        (F.col("n_good") - fresh["n_good"]).alias("n_good"),
        (F.col("n_toxic") - fresh["n_toxic"]).alias("n_toxic"),
    )
    both = texts.select("part", F.explode(F.array(fresh, copies)).alias("x")).select("part", "x.*").filter("n > 0")
    return both.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in SUMS])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs(doc_id, text, lang), labels(doc_id, quality, toxic) -> for each part and order of the filters, the counts of every step.

    A: under 100 words; B: under 80 % of them distinct; C: over 10 % of its code points capitals A-Z; D: holds one of #$%&*|;
    E: its text is that of a smaller doc_id. Null texts are empty ones (and fail A; two of them are copies); null and empty
    languages are the part ''. Rows that share id and text are no copies of each other. A null id is no smaller one and has
    none, so its row doesn't fail E, and no label. An id with several labels has what any of them says. Texts are compared by
    SHA-256; very long ones are read whole, an empty table gives no rows, other columns, whatever their names, are left out. A part
    comes to one task as the sums of at most 32 masks.
    """
    sums = staged(mask_sums(docs.select("doc_id", "text", "lang"), labels.select("doc_id", "quality", "toxic")), "masks")
    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)

    def work(part: pd.DataFrame) -> pd.DataFrame:
        return audited(part).assign(part=part["part"].iloc[0])

    return sums.groupBy("part").applyInPandas(work, schema)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts, orders and steps of the five filters over all documents."""
    return audit(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


OP13_SQL = r"""
WITH known AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
failing AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text),
          regexp_matches(text, '[#$%&*|]'), coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY text), false)] AS f
  FROM d LEFT JOIN known ON d.doc_id = known.doc_id),
masks AS (SELECT part, f, count(*) AS n, sum(good) AS n_good, sum(toxic) AS n_toxic FROM failing GROUP BY part, f),
letter AS (SELECT unnest(range(1, 6)) AS i),
perm AS (
  SELECT [a.i, b.i, c.i, e.i, g.i] AS p
  FROM letter a, letter b, letter c, letter e, letter g
  WHERE a.i NOT IN (b.i, c.i, e.i, g.i) AND b.i NOT IN (c.i, e.i, g.i) AND c.i NOT IN (e.i, g.i) AND e.i <> g.i),
gone AS (
  SELECT part, f, n, n_good, n_toxic, p, coalesce(list_position(list_transform(p, lambda x: f[x]), true), 6) AS gone_at
  FROM masks, perm),
cells AS (SELECT DISTINCT part, p, unnest(range(1, 6)) AS step FROM masks, perm),
counted AS (
  SELECT cells.part, cells.p, cells.step, cells.p[cells.step] AS filter,
         sum(CASE WHEN gone_at > step THEN n ELSE 0 END) AS kept, sum(CASE WHEN gone_at = step THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN f[cells.p[step]] AND gone_at < step THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN f[cells.p[step]] AND len(list_filter(f, lambda x: x)) = 1 THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN gone_at = step THEN n_good ELSE 0 END) AS good_lost, sum(CASE WHEN gone_at = step THEN n_toxic ELSE 0 END) AS toxic_lost
  FROM cells JOIN gone ON cells.part = gone.part AND cells.p = gone.p GROUP BY ALL)
SELECT part, array_to_string(list_transform(p, lambda x: chr(CAST(64 + x AS INT))), '') AS filter_order, CAST(step AS INT) AS step,
       CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley
FROM counted
"""
