"""Resharding by minimum-cost flow: from old shard sizes and new capacities to the transfers that move the fewest bytes."""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import load, unused

OVERHEAD = 16


def least_cost_flow(supply: Sequence[int], room: Sequence[int], cost) -> dict[tuple[int, int], int]:
    """Bytes to send from each old to each new shard: all supply goes out, no room is exceeded, the sum of cost x bytes is least.

    Successive shortest paths with potentials on the graph old shard -> new shard, costs >= 0.
    """
    if sum(supply) > sum(room):
        raise ValueError("the new shards have too little room")
    a, b = len(supply), len(room)
    left, free, flow = list(supply), list(room), defaultdict(int)
    high = [0] * (a + b)
    while any(left):
        dist, prev = [None] * (a + b), [None] * (a + b)
        heap = [(0, i) for i in range(a) if left[i]]
        for _, i in heap:
            dist[i] = 0
        done = set()
        while heap:
            d, u = heapq.heappop(heap)
            if u in done:
                continue
            done.add(u)
            if u < a:
                steps = ((a + j, cost(u, j)) for j in range(b))
            else:
                steps = ((i, -cost(i, u - a)) for i in range(a) if flow[i, u - a])
            for v, c in steps:
                reached = d + c + high[u] - high[v]
                if dist[v] is None or reached < dist[v]:
                    dist[v], prev[v] = reached, u
                    heapq.heappush(heap, (reached, v))
        end = min((j for j in range(a, a + b) if free[j - a] and dist[j] is not None), key=lambda j: dist[j] + high[j])
        top = dist[end]
        for v in range(a + b):
            high[v] += min(dist[v], top) if dist[v] is not None else top
        path, v = [], end
        while prev[v] is not None:
            path.append((prev[v], v))
            v = prev[v]
        most = min([left[v], free[end - a], *(flow[w, u - a] for u, w in path if u >= a)])
        for u, w in path:
            if u < a:
                flow[u, w - a] += most
            else:
                flow[w, u - a] -= most
        left[v] -= most
        free[end - a] -= most
    return {k: v for k, v in flow.items() if v}


def assign(blocks: pd.DataFrame, room: Sequence[int], old_shards: int) -> pd.DataFrame:
    """blocks(old, block, piece, bytes, rows) with the new shard of each and its first slot there.

    The flow says how many bytes go from each old shard to each new one; blocks fill these amounts, largest first, each
    where most is wanting. Then single blocks go from the fullest to the emptiest shard while that brings them nearer.
    """
    blocks = blocks.sort_values(["bytes", "old", "block", "piece"], ascending=[False, True, True, True], ignore_index=True)
    supply = blocks.groupby("old")["bytes"].sum().reindex(range(old_shards), fill_value=0).astype(int).tolist()
    wanting: dict[int, dict[int, int]] = defaultdict(dict)
    for (i, j), n in least_cost_flow(supply, room, lambda i, j: int(i != j)).items():
        wanting[i][j] = n
    shard, held = [], [0] * len(room)
    for old, size in zip(blocks["old"].tolist(), blocks["bytes"].tolist(), strict=True):
        goals = wanting[old]
        j = max(goals, key=lambda j: (goals[j], j == old, -j)) if goals else old % len(room)
        if goals:
            goals[j] -= size
        held[j] += size
        shard.append(j)
    inside = defaultdict(list)
    for k, j in enumerate(shard):
        inside[j].append(k)
    sizes, olds = blocks["bytes"].tolist(), blocks["old"].tolist()
    for _ in range(4 * len(room) + 64):
        gaps = [h - r for h, r in zip(held, room, strict=True)]
        full, empty = max(range(len(room)), key=gaps.__getitem__), min(range(len(room)), key=gaps.__getitem__)
        gap = gaps[full] - gaps[empty]
        fits = [k for k in inside[full] if 0 < sizes[k] < gap]
        if not fits:
            break
        # of blocks that serve about as well, one whose move adds no bytes to those that move anyway
        k = min(fits, key=lambda k: (8 * abs(2 * sizes[k] - gap) // gap, (olds[k] == full) - (olds[k] == empty), abs(2 * sizes[k] - gap), k))
        inside[full].remove(k)
        inside[empty].append(k)
        shard[k] = empty
        held[full] -= sizes[k]
        held[empty] += sizes[k]
    blocks = blocks.assign(shard=shard).sort_values(["shard", "old", "block", "piece"], ignore_index=True)
    return blocks.assign(first_slot=blocks.groupby("shard")["rows"].cumsum() - blocks["rows"])


def size_of(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long")


def reshard(docs: DataFrame, shards: int = 40, old_shards: int = 32, blocks: int = 2048, old: Column | None = None) -> tuple[DataFrame, dict[str, str]]:
    """docs with size, old_shard, shard and slot; the second value maps these to the names they got.

    The old layout is `old` (0 to old_shards - 1), or else a hash of the text. An old shard consists of `blocks` blocks by
    a hash of the text, so that equal texts move together; a block above a quarter of a new shard is cut into pieces by
    another hash of the text, and a piece above a new shard by its texts. Only a text whose copies in an old shard alone exceed a new
    shard is cut by a hash of the id. Sizes of blocks reach the driver, at most old_shards x blocks rows, those of at most 65 pieces for each
    new shard, and of the texts of pieces above a new shard, which are fewer than the shards. Capacities are equal to a byte. Null
    texts have 16 bytes; repeated rows get slots of their own; an empty table gives an empty one; clashing columns of docs
    are kept, ours then start with "_".
    """
    spark = docs.sparkSession
    size, was, block, piece, pieces, shard, slot, first, digest, base, parts_of = unused(docs, "size", "old_shard", "block", "piece", "pieces", "shard", "slot", "first_slot", "digest", "base", "parts_of")
    h = F.col(digest)
    cut = docs.withColumn(digest, F.xxhash64(F.col("text"))).withColumn(size, size_of(F.col("text"))).withColumn(was, (F.pmod(h, F.lit(old_shards)) if old is None else old).cast("int")).withColumn(block, F.pmod(F.shiftright(h, 12), F.lit(blocks)).cast("int"))
    totals = [F.sum(size).alias("bytes"), F.count(F.lit(1)).alias("rows")]
    by = [F.col(was).alias("old"), F.col(block).alias("block")]
    whole = cut.groupBy(*by).agg(*totals).toPandas()
    total = int(whole["bytes"].sum())
    room = [(total * (j + 1)) // shards - (total * j) // shards for j in range(shards)]
    hot = whole[whole["bytes"] * 4 * shards > total] if len(whole) else whole
    split = pd.DataFrame({"o": hot["old"], "b": hot["block"], "n": (hot["bytes"] * 64 * shards) // max(total, 1) + 1}).astype("int32")
    cuts = spark.createDataFrame(split, f"o int, b int, `{pieces}` int")
    cut = cut.join(F.broadcast(cuts), (F.col(was) == F.col("o")) & (F.col(block) == F.col("b")), "left").drop("o", "b")
    cut = cut.withColumn(piece, F.when(F.col(pieces).isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(digest, F.lit("piece")), F.col(pieces)).cast("int")))
    parts = whole.assign(piece=0)
    if len(hot):
        counted = lambda rows, *more: rows.groupBy(*by, F.col(piece).alias("piece"), *more).agg(*totals).toPandas()
        small = counted(cut.filter(F.col(pieces).isNotNull()))
        over = small[small["bytes"] * shards > total]
        if len(over):
            # the texts of such a piece become pieces of their own; what alone exceeds a shard, several by the id
            heavy = spark.createDataFrame(over[["old", "block", "piece"]].astype("int32"), "o int, b int, p int")
            there = (F.col(was) == F.col("o")) & (F.col(block) == F.col("b")) & (F.col(piece) == F.col("p"))
            texts = counted(cut.join(F.broadcast(heavy), there, "left_semi"), F.col(digest).alias("digest")).sort_values(["old", "block", "piece", "digest"], ignore_index=True)
            texts["k"] = ((texts["bytes"] * shards > total) * (texts["bytes"] * 64 * shards // total)).clip(lower=1)
            texts["base"] = (1 << 20) + texts["k"].cumsum() - texts["k"]
            own = spark.createDataFrame(texts[["old", "digest", "base", "k"]].astype("int64"), f"o long, d long, `{base}` long, `{parts_of}` long")
            cut = cut.join(F.broadcast(own), (F.col(was) == F.col("o")) & (h == F.col("d")), "left").drop("o", "d")
            inner = F.col(base) + F.pmod(F.xxhash64("doc_id"), F.col(parts_of))
            cut = cut.withColumn(piece, F.coalesce(inner.cast("int"), F.col(piece))).drop(base, parts_of)
            small = counted(cut.join(F.broadcast(cuts.drop(pieces)), (F.col(was) == F.col("o")) & (F.col(block) == F.col("b")), "left_semi"))
        parts = pd.concat([parts.drop(hot.index), small], ignore_index=True)
    plan = assign(parts, room, old_shards)[["old", "block", "piece", "shard", "first_slot"]].astype("int64")
    put = spark.createDataFrame(plan, f"o int, b int, p int, `{shard}` int, `{first}` long")
    placed = cut.join(F.broadcast(put), (F.col(was) == F.col("o")) & (F.col(block) == F.col("b")) & (F.col(piece) == F.col("p"))).drop("o", "b", "p")
    ordered = Window.partitionBy(was, block, piece).orderBy("doc_id", size, digest)
    placed = placed.withColumn(slot, F.col(first) + F.row_number().over(ordered) - 1)
    return placed.drop(block, piece, pieces, first, digest), {"size": size, "old_shard": was, "shard": shard, "slot": slot}


def affected(placed: DataFrame, names: dict[str, str]) -> DataFrame:
    """The shards whose files must be written anew: those that a row left or entered. No rows: none."""
    moved = placed.filter(F.col(names["old_shard"]) != F.col(names["shard"]))
    return moved.select(F.explode(F.array(names["old_shard"], names["shard"])).alias("shard")).distinct()


def moved_bytes(placed: DataFrame, names: dict[str, str]) -> DataFrame:
    """(old, shard, bytes): what goes from each old shard to each new one."""
    return placed.filter(F.col(names["old_shard"]) != F.col(names["shard"])).groupBy(F.col(names["old_shard"]).alias("old"), F.col(names["shard"]).alias("shard")).agg(F.sum(names["size"]).alias("bytes"))


def rewrite(placed: DataFrame, names: dict[str, str], path: str) -> None:
    """Writes the affected shards below path, a folder shard=n for each; the others' files stay as they are.

    Shards that every row left lose their folder. Run again after a failure, it writes the same; rows may not be read from path.
    """
    touched = F.broadcast(affected(placed, names))  # a row for each shard at most
    rows = placed.join(touched, placed[names["shard"]] == touched["shard"], "left_semi")
    rows.withColumn("shard", F.col(names["shard"])).repartition("shard", F.pmod(F.col(names["slot"]), F.lit(16))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)
    spark = placed.sparkSession
    filled = placed.select(F.col(names["shard"]).alias("filled")).distinct()
    for row in touched.join(filled, F.col("shard") == F.col("filled"), "left_anti").collect():
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/shard={row['shard']}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every document in shards 0 to 39 under the law `bytes`."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    placed, n = reshard(docs.withColumn("text_crc32", F.crc32(F.coalesce("text", F.lit("")))))
    return placed.select("doc_id", n["size"], "text_crc32", F.lit("bytes").alias("law"), n["shard"], n["slot"], F.lit(None).cast("int").alias("grown_shard"), n["old_shard"])
