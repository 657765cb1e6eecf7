"""Removal of repeated passages by enhanced suffix arrays, cut up by content so that equal passages meet in one task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import load, staged
from .decontamination import covered

LENGTH = 200
#: Bytes of the grams that choose where passages meet: the least hash of these inside a window of LENGTH bytes is the window's
#: key. What a key has too much of meets again by the next, longer grams; grams of LENGTH bytes are whole windows.
GRAMS = (24, 176, 192, 200)
#: Bits of a gram's place beside its hash: no more bytes than they count are hashed at once.
PLACE = 24
#: Bytes that are hashed at once, and bytes of one suffix array (and more, where one key has more).
HASHED, SORTED = 2 << 20, 1 << 20
MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
WHOLE, ALONE, WITNESS = 0, 1, 2
#: Segments of one key (40 bytes each) up to which a task classes them at once; beyond that they are settled in buckets.
ROWS = 1 << 16
#: Bytes of one key's different segments up to which they are compared in one suffix array (which takes about 60 times as much
#: memory); beyond that they meet by longer grams, of which there are more the nearer these come to whole windows.
HOT = 4 << 20
#: Most segments that meet by longer grams whose places (28 bytes each) go to all workers, so that texts need not move for them.
BROADCAST_ROWS = 200_000


def loads(text: np.ndarray, order: str, n: int) -> np.ndarray:
    """The 8 bytes from each of the first n places of a text (padded with 8) as one number."""
    return np.ndarray((n,), order + "u8", text.tobytes() if not text.flags.c_contiguous else text, strides=(1,))


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours, from minima to either side inside blocks."""
    n = len(v) - width + 1
    rows = np.append(v, np.full(-len(v) % width, np.iinfo(v.dtype).max, v.dtype)).reshape(-1, width)
    front = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], front[width - 1 : width - 1 + n])


def gram_hashes(text: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the `gram` bytes (a multiple of 8) from each place where there are so many."""
    n = len(text) - gram + 1
    u = loads(np.append(text, np.zeros(8, np.uint8)), "<", len(text))
    h = u[:n] * MIX[0]
    for k in range(8, gram, 8):
        h ^= h >> np.uint64(32)
        h += u[k : k + n]
        h *= MIX[k // 8 % 3]
    return h ^ (h >> np.uint64(29))


def segments(text: np.ndarray, edges: np.ndarray, gram: int, bits: int = PLACE) -> tuple[np.ndarray, ...]:
    """Runs of windows with one key: document, first byte, bytes, key, 128-bit hash of the bytes (two columns), and whether two windows may be equal.

    text: documents one after the other, of 2 ** bits bytes at most; edges: where each begins, and the end. A window's key depends on its bytes
    alone, so equal windows have equal keys, and each window is in one run. Runs overlap by LENGTH - 1 bytes.
    """
    none = (np.zeros(0, np.int64),) * 7
    size = np.diff(edges)
    long = np.flatnonzero(size >= LENGTH)
    if not len(long):
        return none
    h = gram_hashes(text, gram)
    low = np.uint64((1 << bits) - 1)  # the place, so that the first of equal hashes wins
    least = sliding_min((h & ~low) | np.arange(len(h), dtype=np.uint64), LENGTH - gram + 1)
    count = size[long] - LENGTH + 1
    at = np.arange(count.sum()) + np.repeat(edges[:-1][long] - (np.cumsum(count) - count), count)
    doc = np.repeat(long, count)
    anchor = (least[at] & low).astype(np.int64)
    key = h[anchor]
    # grams that are whole windows part these all, also equal neighbours
    new = np.append(True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]) | (gram == LENGTH))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    anchors = np.cumsum(np.append(0, anchor[1:] != anchor[:-1]))
    raw = text.tobytes()
    start, stop = at[first], at[last] + LENGTH
    digest = b"".join(xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(start.tolist(), stop.tolist(), strict=True))
    digest = np.frombuffer(digest, "<i8").reshape(-1, 2)
    return doc[first], start - edges[:-1][doc[first]], stop - start, key[first].view(np.int64), np.ascontiguousarray(digest[:, 0]), np.ascontiguousarray(digest[:, 1]), anchors[last] > anchors[first]


def parts(column: pa.Array, most: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Texts as bytes in parts of `most` at most: the first text's number, the part's place in it, the bytes, the edges.

    A longer text is cut into parts that overlap by LENGTH - 1 bytes, so that each of its windows is in exactly one.
    """
    column = column.cast(pa.large_binary()).fill_null(b"")
    edges = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(edges, edges[a] + most)) - 1)
        b = min(b, len(column))
        size = int(edges[b] - edges[a])
        if size > most:  # a single text
            for k in range(0, size - LENGTH + 1, most - LENGTH + 1):
                piece = data[edges[a] + k : edges[a] + min(k + most, size)]
                yield a, k, piece, np.array([0, len(piece)], np.int64)
        else:
            yield a, 0, data[edges[a] : edges[b]], edges[a : b + 1] - edges[a]
        a = b


def cut(gram: int, text: str, bits: int = PLACE) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (row_key, start, text) -> their segments; start is the text's place in its document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, origin = batch["row_key"].to_numpy(), batch["start"].to_numpy().astype(np.int64)
            for first, begin, raw, edges in parts(batch[text], min(HASHED, 1 << bits)):
                if len(raw) < LENGTH:
                    continue
                doc, start, size, key, d1, d2, twice = segments(raw, edges, gram, bits)
                start = start + begin + origin[first + doc]
                yield pa.record_batch([pa.array(x) for x in (ids[first + doc], (start << 32) | (size << 1) | twice, key, d1, d2)], ["row_key", "place", "key", "d1", "d2"])

    return work


def classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments sorted by key and digest -> those that repeat or may: WHOLE ones have a copy elsewhere; others of a key must be compared."""
    for ids, place, key, d1, d2 in whole_runs(batches, ["row_key", "place", "key", "d1", "d2"]):
        new_key = np.append(True, key[1:] != key[:-1])
        new = new_key | np.append(True, (d1[1:] != d1[:-1]) | (d2[1:] != d2[:-1]))
        kind_at = np.cumsum(new) - 1
        copies = np.bincount(kind_at)[kind_at]
        key_at = np.cumsum(new_key) - 1
        kinds = np.bincount(key_at[new])[key_at]
        whole = copies > 1
        alone = ~whole & ((kinds > 1) | (place & 1 == 1))
        witness = whole & new & (kinds > 1)
        out = [np.flatnonzero(x) for x in (whole, alone, witness)]
        which = np.concatenate(out)
        if len(which):
            kind = np.repeat(np.array([WHOLE, ALONE, WITNESS], np.int32), [len(x) for x in out])
            start, size = place[which] >> 32, (place[which] & 0xFFFFFFFF) >> 1
            yield pa.record_batch([pa.array(x) for x in (kind, ids[which], start.astype(np.int32), size.astype(np.int32), key[which])], ["kind", "row_key", "start", "size", "key"])


def whole_runs(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[list[np.ndarray]]:
    """Numbers sorted by `key`, again in parts that end where a key ends; a row is copied once."""
    held: list[list[np.ndarray]] = []
    at = names.index("key")
    joined = lambda: [np.concatenate(x) for x in zip(*held, strict=True)]
    for batch in batches:
        if not batch.num_rows:
            continue
        more = [batch[x].to_numpy() for x in names]
        key = more[at]
        if held and key[-1] == held[-1][at][-1]:  # the same key still
            held.append(more)
            continue
        end = int(np.searchsorted(key, key[-1]))
        held.append([x[:end] for x in more])
        if found := joined() if any(len(x[0]) for x in held) else None:
            yield found
        held = [[x[end:] for x in more]]
    if held:
        yield joined()


def suffix_array(text: np.ndarray, longest: int) -> list[np.ndarray]:
    """Ranks of all places by their first 8, 16, 32 ... bytes, up to `longest` bytes at least."""
    n = len(text)
    levels = [np.unique(loads(np.append(text, np.zeros(8, np.uint8)), ">", n), return_inverse=True)[1].astype(np.uint64)]
    depth = 8
    while depth < longest:
        rank = levels[-1]
        behind = np.append(rank[depth:] + np.uint64(1), np.zeros(min(depth, n), np.uint64))
        levels.append(np.unique(rank * np.uint64(n + 1) + behind, return_inverse=True)[1].astype(np.uint64))
        depth *= 2
    return levels


def common_prefixes(text: np.ndarray, levels: list[np.ndarray], a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Bytes that the suffixes at a and b share, `most` at most."""
    n, lcp = len(text), np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        at, to = a + lcp, b + lcp
        inside = (at < n) & (to < n)
        same = inside & (levels[k][np.where(inside, at, 0)] == levels[k][np.where(inside, to, 0)])
        lcp += np.where(same, 8 << k, 0)
    for _ in range(7):
        at, to = np.minimum(a + lcp, n - 1), np.minimum(b + lcp, n - 1)
        lcp += (a + lcp < n) & (b + lcp < n) & (text[at] == text[to])
    return np.minimum(lcp, most)


def maximal_repeats(lcp: list[int], left: list[int]) -> tuple[list[tuple[int, int, int]], list[int]]:
    """The intervals (depth, first, last) of suffixes with a longest common prefix that not all have the same byte in front.

    lcp[i]: of suffixes i and i + 1; left[i]: the byte in front, below 0 if none. A stack holds the intervals that are
    open; an interval's left byte is that of all its suffixes, or MANY. Also, for each suffix, the depth of the
    deepest of these intervals that it is in (0: none), as each interval ends behind those inside it.
    """
    many, found, depth_of, unset = -1, [], [0] * len(left), list(range(len(left) + 1))

    def free(i: int) -> int:
        while unset[i] != i:
            unset[i] = unset[unset[i]]
            i = unset[i]
        return i

    def joined(a: int, b: int) -> int:
        return a if a == b and a >= 0 else many

    stack: list[list[int]] = []  # depth, first, left byte
    for i in range(len(left)):
        depth = lcp[i - 1] if i else 0
        first, byte = i - 1, left[i - 1] if i else many
        while stack and stack[-1][0] > depth:
            top = stack.pop()
            top[2] = joined(top[2], byte)
            if top[2] == many:
                found.append((top[0], top[1], i - 1))
                j = free(top[1])
                while j < i:
                    depth_of[j] = top[0]
                    unset[j] = j + 1
                    j = free(j)
            first, byte = top[1], top[2]
        if not i or not depth:
            continue
        if stack and stack[-1][0] == depth:
            stack[-1][2] = joined(stack[-1][2], byte)
        else:
            stack.append([depth, first, byte])
    byte = left[-1]
    while stack:
        top = stack.pop()
        top[2] = joined(top[2], byte)
        if top[2] == many:
            found.append((top[0], top[1], len(left) - 1))
            j = free(top[1])
            while j < len(left):
                depth_of[j] = top[0]
                unset[j] = j + 1
                j = free(j)
        byte = top[2]
    return found, depth_of


def repeats(contents: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Maximal repeats of LENGTH bytes and more in the contents: length, the contents and places of all occurrences, cover.

    cover is the same places' greatest length in any of their repeats (as many as occurrences; 0 where the interval is
    not their deepest), so that the union of cover is what the repeats cover.
    """
    text = np.frombuffer(b"".join(contents), np.uint8)
    size = np.array([len(c) for c in contents])
    edges = np.cumsum(size) - size
    count = np.maximum(size - LENGTH + 1, 0)
    at = np.arange(count.sum()) + np.repeat(edges - (np.cumsum(count) - count), count)
    owner = np.repeat(np.arange(len(contents)), count)
    levels = suffix_array(text, int(size.max()))
    order = np.argsort(levels[-1][at], kind="stable")
    at, owner = at[order], owner[order]
    room = (edges + size)[owner] - at
    lcp = common_prefixes(text, levels, at[:-1], at[1:], np.minimum(room[:-1], room[1:]))
    left = np.where(at > edges[owner], text[np.maximum(at - 1, 0)].astype(np.int64), -1)
    high = np.flatnonzero(np.diff(np.concatenate(([0], (lcp >= LENGTH).astype(np.int8), [0]))))
    for a, b in zip(high[::2].tolist(), high[1::2].tolist(), strict=True):
        own = left[a : b + 1]
        if own[0] >= 0 and (own == own[0]).all():
            continue  # part of a longer repeat
        found, deepest = maximal_repeats(lcp[a:b].tolist(), own.tolist())
        deepest = np.array(deepest)
        for depth, i, j in found:
            if depth >= LENGTH:
                some = slice(a + i, a + j + 1)
                yield depth, owner[some], at[some] - edges[owner[some]], np.where(deepest[i : j + 1] == depth, depth, 0)


def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each segment's content once in a task, however many equal rows have it."""
    seen: set[tuple] = set()
    names = ["key", "row_key", "start", "kind"]
    for batch in batches:
        first = []
        for row in zip(*[batch[x].to_pylist() for x in names], strict=True):
            first.append(row not in seen)
            seen.add(row)
        yield batch.select([*names, "content"]).filter(pa.array(first, pa.bool_()))


def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contents sorted by key -> what maximal repeats cover in those of kind ALONE, as spans of their documents."""
    held: list[tuple[int, int, int, int, bytes]] = []
    size = 0

    def flush() -> pa.RecordBatch | None:
        spans: list[list[tuple[int, int]]] = [[] for _ in held]
        for _, owner, place, cover in repeats([r[4] for r in held]):
            some = np.flatnonzero(cover)
            for o, p, c in zip(owner[some].tolist(), place[some].tolist(), cover[some].tolist(), strict=True):
                spans[o].append((p, p + c))
        out = [(r[1], (r[2] + a << 32) | (r[2] + b)) for r, own in zip(held, spans, strict=True) if r[3] == ALONE for a, b in covered(own)]
        return pa.record_batch([pa.array([r[i] for r in out], pa.int64()) for i in (0, 1)], ["row_key", "span"])

    for batch in batches:
        for row in zip(*[batch[x].to_pylist() for x in ("key", "row_key", "start", "kind", "content")], strict=True):
            if held and row[:4] == held[-1][:4]:
                continue  # of an equal row, from another task
            if size >= SORTED and row[0] != held[-1][0]:
                yield flush()
                held, size = [], 0
            held.append(row)
            size += len(row[4])
    if held:
        yield flush()


def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "n_removed", "spans", "kept"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
    for batch in batches:
        out = []
        for doc, text, spans in zip(batch["doc_id"].to_pylist(), batch["text"], batch["spans"].to_pylist(), strict=True):
            raw = (text.as_py() or "").encode()
            runs = covered([(s >> 32, s & 0xFFFFFFFF) for s in spans or []])
            kept = b"".join(raw[a:b] for a, b in zip([0, *(b for _, b in runs)], [*(a for a, _ in runs), len(raw)], strict=True))
            out.append((doc, len(raw), len(raw) - len(kept), [a << 32 | b for a, b in runs], kept))
        yield pa.record_batch([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)


SEGMENT, MARKED = "row_key long, place long, key long, d1 long, d2 long", "kind int, row_key long, start int, size int, key long"
CONTENT = "key long, row_key long, start int, kind int, content binary"
DIGEST = ["key", "d1", "d2"]


def marked(segments: DataFrame, rows: int) -> DataFrame:
    """Staged segments -> MARKED, as classed() gives them, whatever number of segments share a key.

    A key with over `rows` segments isn't gathered: its rows are dealt into buckets of about half as many. Segments that have an
    equal one in their bucket are settled there; one of each kind in each bucket goes on to be counted over all buckets, by sums
    that start inside tasks, and only those that were alone in their bucket ask for that count.
    """
    hot = staged(segments.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > rows), "hot-keys")
    classes = lambda some: some.repartition("key").sortWithinPartitions(*DIGEST).mapInArrow(classed, MARKED)
    if not hot.limit(1).count():
        return classes(segments)
    many = segments.join(hot, "key")
    bucket = F.pmod(F.xxhash64("row_key", "place"), F.floor(F.col("n") * 2 / rows) + 1)
    own = Window.partitionBy(*DIGEST, "bucket")
    settled = many.withColumn("bucket", bucket).withColumn("same", F.count(F.lit(1)).over(own)).withColumn("number", F.row_number().over(own.orderBy("row_key", "place")))
    settled = staged(settled.select("row_key", "place", *DIGEST, "same", F.col("number") == 1), "settled").toDF("row_key", "place", *DIGEST, "same", "first")
    kinds = settled.filter("first").groupBy(*DIGEST).agg(F.sum("same").alias("n"), F.min(F.struct("row_key", "place")).alias("one"), F.max(F.col("place").bitwiseAND(F.lit(1))).alias("twice"))
    kinds = staged(kinds, "kinds")
    several = kinds.groupBy("key").agg(F.count(F.lit(1)).alias("kinds"))
    asked = kinds.join(several, "key").filter("kinds > 1 OR (n = 1 AND twice = 1)").select(F.when(F.col("n") > 1, WITNESS).otherwise(ALONE).alias("kind"), "one.row_key", "one.place", "key")
    alone = settled.filter("same = 1").join(kinds.filter("n > 1").select(*DIGEST), DIGEST, "left_semi")
    whole = settled.filter("same > 1").unionByName(alone).select(F.lit(WHOLE).alias("kind"), "row_key", "place", "key")
    start, size = F.shiftright("place", 32).cast("int"), F.shiftright(F.col("place").bitwiseAND(F.lit(0xFFFFFFFF)), 1).cast("int")
    found = asked.unionByName(whole).select("kind", "row_key", start.alias("start"), size.alias("size"), "key")
    return classes(segments.join(hot, "key", "left_anti")).unionByName(found)


def spans_of(docs: DataFrame, hot: int | None = None, rows: int | None = None, grams: tuple[int, ...] = GRAMS) -> DataFrame:
    """docs(row_key, text, any others) -> row_key, span (start << 32 | end): bytes that a string of LENGTH bytes covers that starts twice.

    Windows meet by their key. Segments of one key with equal bytes (by 128-bit hashes beside the key) are one kind, all of
    whose places are covered whole; one segment of each kind is compared with the key's others byte by byte in a suffix
    array. Only segments' hashes are shuffled for all documents, and bytes for those that must be compared. Where segments
    of over `hot` bytes share a key, as around a passage that very many documents have, these meet again by
    longer grams, which such places don't share unless they do repeat; the last grams are whole windows, that is, the
    suffixes are dealt out by the first LENGTH bytes, as the intervals of the suffix array that matter are.
    """
    hot, rows = HOT if hot is None else hot, ROWS if rows is None else rows
    cast = F.col("text").cast("binary")
    pieces = docs.select("row_key", F.lit(0).alias("start"), "text")
    found = None
    for gram in grams:
        column = "text" if gram == grams[0] else "content"
        own = staged(marked(staged(pieces.mapInArrow(cut(gram, column), SEGMENT), "segments"), rows), "marked")
        end = (F.col("start") + F.col("size")).cast("long")
        whole = own.filter(F.col("kind") == WHOLE).select("row_key", F.shiftleft(F.col("start").cast("long"), 32).bitwiseOR(end).alias("span"))
        found = whole if found is None else found.unionAll(whole)
        if gram == LENGTH:  # equal windows have one kind: nothing is left to compare
            break
        asked = own.filter(F.col("kind") != WHOLE)
        common = staged(asked.groupBy("key").agg(F.sum("size").alias("n")).filter(F.col("n") > hot).select("key"), "common-keys")
        raw = F.substring(cast, F.col("start") + 1, F.col("size")).alias("content")
        others = [c for c in docs.columns if c not in ("row_key", "text")]
        # with all columns, texts are dealt out as they are for what follows, and Spark does it once for both
        contents = lambda some: some.join(docs, "row_key").select("key", "row_key", "start", "kind", raw, *others).mapInArrow(once, CONTENT)
        more = common.limit(1).count() > 0
        cold = contents(asked.join(common, "key", "left_anti") if more else asked)
        found = found.unionAll(cold.repartition("key").sortWithinPartitions("key", "row_key", "start", "kind").mapInArrow(compared, "row_key long, span long"))
        if not more:
            break
        again = staged(asked.join(common, "key", "left_semi"), "common-segments")
        few = again.count() <= BROADCAST_ROWS
        pieces = contents(F.broadcast(again) if few else again).select("row_key", "start", "content")
    return found


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_bytes, n_removed, spans (removed runs of bytes, start << 32 | end), kept (bytes).

    Strings are judged on the input, overlaps count, and a string may repeat inside one document; none crosses documents.
    Null texts are empty; texts under LENGTH bytes and empty tables have nothing to remove; very long texts are taken whole;
    rows that repeat a document repeat its strings, so all of both goes; null ids stay; other columns of docs, whatever their
    names, are left out. Rows are known by a 64-bit hash of id and text.
    """
    keyed = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64(F.col("doc_id"), F.col("text")).alias("row_key"))
    spans = spans_of(keyed).groupBy("row_key").agg(F.collect_set("span").alias("spans"))
    joined = keyed.join(spans, "row_key", "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(rest, "doc_id long, n_bytes long, n_removed long, spans array<long>, kept binary")


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without bytes of 200-byte strings that start anywhere else too."""
    found = remove_repeats(load(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


OP3_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents),
p AS (SELECT r, c, n, substr(h, 2 * c + 1, 910) AS h FROM (SELECT r, n, h, unnest(range(0, n - 199, 256)) AS c FROM d WHERE n >= 200)),
w AS (SELECT r, c + j AS i, md5_number(substr(h, 2 * j + 1, 400)) AS k FROM (SELECT r, c, h, unnest(range(0, least(256, n - 199 - c))) AS j FROM p)),
twice AS (SELECT k FROM w GROUP BY k HAVING count(*) > 1),
hit AS (SELECT r, i FROM w SEMI JOIN twice USING (k)),
steps AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 200 THEN 0 ELSE 1 END AS new FROM hit),
islands AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS island FROM steps),
runs AS (SELECT r, min(i) AS a, max(i) + 200 AS b FROM islands GROUP BY r, island),
gaps AS (
  SELECT r, b AS start, lead(a) OVER (PARTITION BY r ORDER BY a) AS stop FROM runs
  UNION ALL SELECT r, 0, min(a) FROM runs GROUP BY r
  UNION ALL SELECT r, 0, NULL FROM d ANTI JOIN runs USING (r)),
kept AS (SELECT r, string_agg(substr(h, 2 * start + 1, 2 * (coalesce(stop, n) - start)), '' ORDER BY start) AS h FROM gaps JOIN d USING (r) GROUP BY r),
sums AS (SELECT r, sum(b - a) AS removed, count(*) AS spans FROM runs GROUP BY r)
SELECT doc_id, n AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(kept.h)) AS kept_sha256
FROM d JOIN kept USING (r) LEFT JOIN sums USING (r)
"""
