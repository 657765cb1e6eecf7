"""SimHash near-duplicates: fingerprints embedded as popcounts of segments, joined on a grid, verified bit by bit."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, staged

SEED = 42
RADIUS = 4
#: The embedding: the 64 bits as 32 segments of two bits, a popcount of 0 to 2 for each.
SEGMENTS = 32
LOW_BITS = 0x5555555555555555
#: Members of a grid cell up to which all of its pairs are compared at once, and up to which one task has the cell at all.
SMALL_CELL, CELL = 64, 2048


def fingerprint(text: str | None, width: int = 4) -> int:
    """A bit is 1 if it is set in over half of the hashes of the text's shingles; no words: 0."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter((len(w) + 1 for w in words), np.int64, len(words))) - 1
    n = max(1, len(words) - width + 1)
    starts = np.concatenate(([0], ends[: n - 1] + 1)).tolist()
    ends = ends[width - 1 :].tolist() or [len(joined)]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for k in range(0, n, 65536):
        counts += np.unpackbits(hashes[k : k + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 4, **beside: Column) -> DataFrame:
    """docs(doc_id, text) -> doc_id, fp (64 bits as a long), and the longs beside."""
    names = ["doc_id", *beside]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x.as_py(), width) for x in batch["text"]], np.uint64)
            yield pa.record_batch([*[batch[c] for c in names], pa.array(found.view(np.int64))], [*names, "fp"])

    own = docs.select(F.col("doc_id").cast("long"), *[v.alias(k) for k, v in beside.items()], "text")
    return own.mapInArrow(work, ", ".join(f"{c} long" for c in [*names, "fp"]))


def signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def popcounts(fp: Column) -> Column:
    """The popcounts of all segments, each written as that many ones: 00, 01 or 11.

    So the Manhattan distance of two vectors of popcounts is the number of bits in which these differ. It is never above
    the Hamming distance of the fingerprints.
    """
    low, high = fp.bitwiseAND(F.lit(LOW_BITS)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(LOW_BITS))
    return F.shiftleft(low.bitwiseAND(high), 1).bitwiseOR(low.bitwiseOR(high))


def embedded(fps: np.ndarray) -> np.ndarray:
    """popcounts(...) of an array."""
    low, high = fps & np.uint64(LOW_BITS), (fps >> np.uint64(1)) & np.uint64(LOW_BITS)
    return ((low & high) << np.uint64(1)) | low | high


def grid_masks(n: int, radius: int = RADIUS) -> list[int]:
    """Projections of the grid: of g groups of segments, at least g - radius are equal in vectors within the radius.

    g grows with the number of fingerprints, so that a cell has few members by chance (two equal segments: 3 in 8). A
    fingerprint goes to 15 cells of up to 280 thousand fingerprints, to 35 up to 5 million, 70 up to 50 million, 126 up to 300
    million, 210 up to a billion, and to 330 beyond that.
    """
    for g in range(radius + 2, radius + 8):
        if n * 0.375 ** (SEGMENTS * (g - radius) / g) <= 8:
            break
    edges = [SEGMENTS * k // g for k in range(g + 1)]
    fields = [((1 << 2 * b) - 1) ^ ((1 << 2 * a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(fields, g - radius)]


def near(a: np.ndarray, b: np.ndarray, ta: np.ndarray, tb: np.ndarray, radius: int) -> np.ndarray:
    """Which pairs are within the radius: the Manhattan distance of their popcounts first, the bits of those that it leaves."""
    found = np.bitwise_count(ta ^ tb) <= radius
    some = np.nonzero(found)
    pick = lambda x: np.broadcast_to(x, found.shape)[some]
    found[some] = np.bitwise_count(pick(a) ^ pick(b)) <= radius
    return found


def cell_links(fps: np.ndarray, starts: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (fp, smaller fp) that connect, in each cell, exactly what all pairs within the radius would connect.

    fps: cells one after the other, sorted inside; starts: where each begins.
    """
    ends = np.append(starts[1:], len(fps))
    out_a, out_b = [], []
    size = ends - starts
    small = np.flatnonzero((size > 1) & (size <= SMALL_CELL))
    codes = embedded(fps)
    if len(small):
        own = np.repeat(ends[small], size[small])
        at = np.concatenate([np.arange(len(own)) - np.repeat(np.cumsum(size[small]) - size[small], size[small]) + np.repeat(starts[small], size[small])])
        pairs = []
        for step in range(1, int(size[small].max())):
            inside = at + step < own
            at, own = at[inside], own[inside]
            close = near(fps[at], fps[at + step], codes[at], codes[at + step], radius)
            pairs.append((at[close], at[close] + step))
        i, j = (np.concatenate(x) for x in zip(*pairs, strict=True))
        label = np.arange(len(fps))
        while True:  # the smallest member that a pair reaches, then its own
            before = label.copy()
            np.minimum.at(label, j, label[i])
            np.minimum.at(label, i, label[j])
            label = label[label]
            if np.array_equal(label, before):
                break
        moved = np.flatnonzero(label != np.arange(len(fps)))
        out_a.append(fps[moved])
        out_b.append(fps[label[moved]])
    for k in np.flatnonzero(size > SMALL_CELL):
        a, b = search(fps[starts[k] : ends[k]], radius)
        out_a.append(a)
        out_b.append(b)
    empty = np.zeros(0, np.uint64)
    return np.concatenate([empty, *out_a]), np.concatenate([empty, *out_b])


def search(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for one larger cell: searches from each member among those that no search has reached."""
    rest, a, b = np.sort(fps), [], []
    codes = embedded(rest)
    while len(rest) > 1:
        root, code = rest[0], codes[0]
        rest, codes = rest[1:], codes[1:]
        reached = [(root, code)]
        while reached and len(rest):
            at, code = reached.pop()
            close = near(at, rest, code, codes, radius)
            found = rest[close]
            reached.extend(zip(found, codes[close], strict=True))
            rest, codes = rest[~close], codes[~close]
            a.extend(found)
            b.extend([root] * len(found))
    return np.array(a, np.uint64), np.array(b, np.uint64)


def links(distinct: DataFrame, n: int, radius: int = RADIUS, most: int | None = None) -> DataFrame:
    """distinct(fp), n of them -> links (a, b), b < a as unsigned numbers, that connect what the radius connects.

    A cell of over `most` members isn't gathered: its members are dealt into blocks, and each two blocks meet in a task.
    """
    most = most or CELL
    p = popcounts(F.col("fp"))
    cells = F.array(*[F.struct(F.lit(k).alias("grid"), p.bitwiseAND(F.lit(signed(m))).alias("cell")) for k, m in enumerate(grid_masks(n, radius))])
    spread = distinct.select("fp", F.explode(cells).alias("at")).select("at.grid", "at.cell", "fp")
    dense = staged(spread.groupBy("grid", "cell").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most), "dense-cells")

    def table(a: np.ndarray, b: np.ndarray) -> pa.Table:
        pair = np.unique(np.stack([a, b], axis=1), axis=0).view(np.int64)
        return pa.table({c: np.ascontiguousarray(pair[:, k]) for k, c in enumerate("ab")})

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, fps in whole_cells(batches):
            starts = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1)))
            a, b = cell_links(fps, starts, radius)
            if len(a):
                yield from table(a, b).to_batches()

    def blocks(key: tuple, x: pa.Table, y: pa.Table) -> pa.Table:
        fps = np.unique(np.append(x["fp"].to_numpy(), y["other"].to_numpy()).view(np.uint64))
        return table(*search(fps, radius))

    def gathered(some: DataFrame) -> DataFrame:
        return some.repartition("grid", "cell").sortWithinPartitions("grid", "cell").mapInArrow(work, "a long, b long")

    if not dense.limit(1).count():
        return gathered(spread).distinct()
    many = spread.join(dense, ["grid", "cell"]).withColumn("m", F.floor(F.col("n") * 2 / most).cast("int") + 1)
    many = many.select("grid", "cell", "fp", "m", F.pmod(F.xxhash64("fp"), F.col("m")).cast("int").alias("own"))
    left = many.select("grid", "cell", "fp", F.col("own").alias("p"), F.explode(F.sequence(F.col("own"), F.col("m") - 1)).alias("q"))
    right = many.select(*[F.col(c).alias(f"{c}2") for c in ("grid", "cell")], F.col("fp").alias("other"), F.explode(F.sequence(F.lit(0), F.col("own"))).alias("p2"), F.col("own").alias("q2"))
    met = left.groupBy("grid", "cell", "p", "q").cogroup(right.groupBy("grid2", "cell2", "p2", "q2")).applyInArrow(blocks, "a long, b long")
    return gathered(spread.join(dense, ["grid", "cell"], "left_anti")).unionByName(met).distinct()


def whole_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted rows again in parts that end where a cell ends: keys (grid, cell) and fingerprints; a row is copied once."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    joined = lambda: tuple(np.concatenate(x) for x in zip(*held, strict=True))
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch["grid"].to_numpy().astype(np.int64), batch["cell"].to_numpy()], axis=1)
        fps = batch["fp"].to_numpy().view(np.uint64)
        other = (keys != keys[-1]).any(axis=1)
        if not other.any() and held and (held[-1][0][-1] == keys[-1]).all():  # the same cell still
            held.append((keys, fps))
            continue
        end = int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0
        held.append((keys[:end], fps[:end]))
        if any(len(f) for _, f in held):
            yield joined()
        held = [(keys[end:], fps[end:])]
    if held:
        yield joined()


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) -> node, root: the smallest node (as a signed number) that each reaches.

    Labels fall to the least among neighbours, then to the label's own label, until none changes; each round is written
    to the shared folder. A hub's rows are summed before they are shuffled.
    """
    both = staged(edges.union(edges.select("b", "a")).toDF("a", "b"), "links")
    label = staged(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "labels")
    while True:
        near = both.join(label.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        lower = label.join(near, "node").select("node", "root", F.least("root", "near").alias("low"))
        jump = lower.select(F.col("node").alias("low"), F.col("low").alias("lowest"))
        after = staged(lower.join(jump, "low").select("node", F.col("root").alias("was"), F.col("lowest").alias("root")), "labels")
        label = after.select("node", "root")
        if after.filter("was <> root").limit(1).count() == 0:
            return label


def near_duplicates(docs: DataFrame, width: int = 4, radius: int = RADIUS) -> DataFrame:
    """docs(doc_id, text) -> doc_id, fp, component_id: the smallest id among all documents that links reach.

    Exact copies share a fingerprint, so only distinct fingerprints are joined, and each class comes back to its documents
    by an equi-join that Spark splits if one fingerprint is hot. Null and empty texts have fingerprint 0, linked like any
    other; very long texts count whole; null ids never name a component unless all its ids are null; repeated rows are copies;
    no rows give none; other columns of docs, whatever their names, are left out.
    """
    found = staged(fingerprints(docs, width), "fingerprints")
    kinds = staged(found.groupBy("fp").agg(F.min("doc_id").alias("first")), "kinds")
    linked = staged(links(kinds.select("fp"), kinds.count(), radius), "edges")
    roots = components(linked)
    named = kinds.join(roots, kinds["fp"] == roots["node"]).select("fp", "root", "first")
    names = named.groupBy("root").agg(F.min("first").alias("least"))
    named = named.join(names, "root").select(F.col("fp").alias("f"), "least")
    classes = staged(kinds.join(named, kinds["fp"] == named["f"], "left").select("fp", F.coalesce("least", "first").alias("component_id")), "classes")
    return found.join(classes, "fp").select("doc_id", "fp", "component_id")


def deduplicate(docs: DataFrame) -> DataFrame:
    """One row of docs, with all its columns, for each component: the one with the smallest id, null ids last.

    A row is known by its id and a 64-bit hash of its text, so rows of other texts that share an id (or have none) are
    judged apart; a component is known by its root, so that one without any id keeps a row too. Rows equal in id and
    text are one (any of them, where other columns differ). Null and empty texts are one component; extra columns, whatever
    their names, stay; an empty table gives an empty one.
    """
    text_key = F.xxhash64(F.col("text"))
    rows = fingerprints(docs, text_key=text_key).groupBy("fp", "doc_id", "text_key").agg(F.count(F.lit(1)).alias("rows"))
    first = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_key", "rows")
    kinds = staged(rows.groupBy("fp").agg(F.min(first).alias("first")), "kinds")
    roots = components(staged(links(kinds.select("fp"), kinds.count()), "edges"))
    named = kinds.join(roots, kinds["fp"] == roots["node"], "left").groupBy(F.coalesce("root", "fp").alias("root"))
    kept = staged(named.agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias("kept_id"), F.col("first.text_key").alias("kept_text"), F.col("first.rows").alias("rows")), "kept")
    one = docs.join(kept, docs["doc_id"].eqNullSafe(kept["kept_id"]) & (F.xxhash64(docs["text"]) == kept["kept_text"]), "left_semi")
    # texts are only shuffled once more where a row is repeated
    return one.dropDuplicates(["doc_id", "text"]) if kept.filter("rows > 1").limit(1).count() else one


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(load(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
