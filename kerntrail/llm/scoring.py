"""Language-model scoring: an interpolated modified Kneser-Ney n-gram model in sorted hash arrays that workers memory-map."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import FOLD_SQL, REMEMBERED, fold, load, new_folder

#: Bytes of text for each shard of the model, and tokens that a task counts or scores at once.
SHARD_BYTES = 24 << 20
COUNT_TOKENS, SCORE_TOKENS = 3_000_000, 600_000
#: Most shards that a block is sent to at once; where there are more, blocks go to groups of shards first, so that the rows sent
#: grow with the tokens, and each group is sent on in as many tasks as PARTS.
FAN, PARTS = 1024, 16
#: Tokens of an n-gram unless asked otherwise.
ORDER = 2
#: Contexts with so great a share of the tokens are spread over all shards; rows of the sample that finds them (expected).
HOT_SHARE, HOT_ROWS = 0.005, 2_000
#: Marks in front of and behind a text. Words never hold white space, so these hash apart from all words.
FRONT, END = xxhash.xxh3_64_intdigest(b" front"), xxhash.xxh3_64_intdigest(b" end")


class Hashes(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= REMEMBERED:
            if len(self) >= 1_000_000:
                self.clear()
            self[word] = value
        return value


def tokens(text: str | None, hashes: Hashes) -> np.ndarray:
    """The front mark, the words (A-Z lower-cased, cut at ASCII white space) and the end, as hashes."""
    words = (text or "").encode().lower().split()
    out = np.empty(len(words) + 2, np.uint64)
    out[0], out[-1] = FRONT, END
    out[1:-1] = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    return out


def pair_keys(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    k = u * np.uint64(0x9E3779B97F4A7C15) + w
    k ^= k >> np.uint64(29)
    k *= np.uint64(0xBF58476D1CE4E5B9)
    return k ^ (k >> np.uint64(32))


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    """The shard of a hash; it never falls as the hash grows."""
    return ((h >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


def gram_keys(columns: list[np.ndarray]) -> np.ndarray:
    """One 64-bit key for each row of words; a single word is its own key."""
    keys = columns[0]
    for w in columns[1:]:
        keys = pair_keys(keys, w)
    return keys


def gram_shards(context: np.ndarray, w: np.ndarray, shards: int, hot: np.ndarray) -> np.ndarray:
    """By the context's key; grams of hot contexts by the word."""
    spread = np.isin(context, hot)
    return np.where(spread, shard_of(w * np.uint64(0x9E3779B97F4A7C15), shards), shard_of(context, shards)).astype(np.int64)


def joined(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Texts behind each other, and how many tokens of its text stand in front of each token."""
    sizes = np.array([len(t) for t in texts])
    return np.concatenate(texts), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def grams_at(flat: np.ndarray, at: np.ndarray, k: int) -> list[np.ndarray]:
    """The k words that end at each of the places."""
    return [flat[at - j] for j in range(k - 1, -1, -1)]


def narrow(c: np.ndarray) -> np.ndarray:
    """Counts as 32 bits where all fit."""
    return c.astype(np.uint32 if not len(c) or c.max() < 1 << 32 else np.uint64)


def summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct keys, and each value summed for each."""
    order = np.argsort(keys)
    keys = keys[order]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return (keys[starts], *(np.add.reduceat(v[order], starts) if len(starts) else v for v in values))


def text_bytes(text: Column) -> Column:
    return F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("bytes")


def hot_contexts(docs: DataFrame, order: int) -> dict[int, np.ndarray]:
    """For each length of grams, keys of contexts with a great share of all, found on a bounded sample; they only decide where grams are counted."""
    parts = docs.count() // HOT_ROWS + 1
    sample = docs.filter(F.pmod(F.xxhash64("doc_id", F.lit("hot")), F.lit(parts)) == 0)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            for text in batch["text"]:
                t = tokens(text.as_py(), hashes)
                for k in range(2, order + 1):
                    key, n = np.unique(gram_keys(grams_at(t, np.arange(k - 2, len(t) - 1), k - 1)), return_counts=True)
                    yield pa.record_batch([pa.array(np.full(len(key), k, np.int32)), pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], ["k", "key", "n"])

    found = sample.select("text").mapInArrow(work, "k int, key long, n long").groupBy("k", "key").agg(F.sum("n").alias("n"))
    total = found.filter("k = 2").agg(F.sum("n")).first()[0] or 0
    rows = found.filter(F.col("n") >= max(1, HOT_SHARE * total)).collect()
    return {k: np.array(sorted({*([FRONT] if k == 2 else []), *(r["key"] & (1 << 64) - 1 for r in rows if r["k"] == k)}), np.uint64) for k in range(2, order + 1)}


def write_arrays(path: str, *arrays: np.ndarray) -> None:
    """Arrays one after the other behind their lengths; in place at once, so that a task may be run again."""
    part = f"{path}.{os.getpid()}.{TaskContext.get().taskAttemptId()}"
    with open(part, "wb") as file:
        np.array([len(a) for a in arrays], np.int64).tofile(file)
        for a in arrays:
            a.tofile(file)
    os.replace(part, path)


def map_arrays(path: str, *kinds: str) -> list[np.ndarray]:
    """The arrays of a file; the last one's width follows from the file's size."""
    raw = np.memmap(path, np.uint8, "r")
    sizes, at, out = raw[: 8 * len(kinds) + 8].view(np.int64), 8 * len(kinds) + 8, []
    for n, kind in zip(sizes.tolist(), kinds, strict=False):
        width = np.dtype(kind).itemsize * n
        out.append(raw[at : at + width].view(kind))
        at += width
    return [*out, counts_in(raw[at:], int(sizes[-1]))]


def counts_in(data: np.ndarray, n: int) -> np.ndarray:
    """What narrow() wrote."""
    return data.view(np.uint64 if n and len(data) == 8 * n else np.uint32)


STATS = "kind string, key long, block binary, a long, b long, c long, d long"
NAMES = ["kind", "key", "block", "a", "b", "c", "d"]


def stats_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.binary(), *[pa.int64()] * 4]
    return pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], NAMES)


def of_counts(n: np.ndarray) -> list[int]:
    return [int((n == k).sum()) for k in (1, 2, 3, 4)]


def ends_of(to: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Runs of equal destinations."""
    cuts = np.flatnonzero(np.diff(to)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(to)], strict=True):
        if a < b:
            yield int(to[a]), slice(int(a), int(b))


def gram_blocks(columns: list[np.ndarray], c: np.ndarray, to: np.ndarray) -> list[tuple]:
    """Distinct grams with their counts as rows of STATS, one for each destination: its distinct words once, grams by their numbers."""
    order = np.lexsort((columns[0], to))
    columns, c, to, out = [x[order] for x in columns], c[order], to[order], []
    for s, own in ends_of(to):
        words, at = np.unique(np.concatenate([x[own] for x in columns]), return_inverse=True)
        planes = at.astype("<u4").view(np.uint8).reshape(-1, 4).T  # bytes of one rank together: the high ones are zeros, which the shuffle compresses
        data = np.array([len(words), own.stop - own.start], np.int64).tobytes() + words.tobytes() + planes.tobytes() + narrow(c[own]).tobytes()
        out.append((grams(len(columns)), s, data, 0, 0, 0, 0))
    return out


def grams(k: int) -> str:
    return f"grams of {k}"


def grams_of(block: bytes, k: int) -> tuple[np.ndarray, ...]:
    """The words of a block's grams, a column for each place, and their counts."""
    known, n = np.frombuffer(block, np.int64, 2).tolist()
    words, planes = np.frombuffer(block, np.uint64, known, 16), np.frombuffer(block, np.uint8, 4 * k * n, 16 + 8 * known)
    at = np.ascontiguousarray(planes.reshape(4, k * n).T).view("<u4")
    c = counts_in(np.frombuffer(block, np.uint8, -1, 16 + 8 * known + 4 * k * n), n)
    return *words[at].reshape(k, n), c.astype(np.int64)


def added_grams(*found: np.ndarray) -> tuple[np.ndarray, ...]:
    """Columns of words and counts as distinct grams in the order of their keys: keys, columns, summed counts."""
    *columns, c = found
    keys = gram_keys(columns)
    order = np.argsort(keys)
    keys, c = keys[order], c[order]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], *(x[order[starts]] for x in columns), np.add.reduceat(c, starts) if len(starts) else c


def word_blocks(word: np.ndarray, contexts: np.ndarray, n: np.ndarray, to: np.ndarray) -> list[tuple]:
    """Words (sorted, as destinations are) with their contexts and tokens as rows of STATS, one for each destination."""
    out = []
    for s, own in ends_of(to):
        data = np.array([own.stop - own.start], np.int64).tobytes() + word[own].tobytes() + contexts[own].astype(np.uint32).tobytes() + n[own].astype(np.uint64).tobytes()
        out.append(("words", s, data, 0, 0, 0, 0))
    return out


def words_of(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = int(np.frombuffer(block, np.int64, 1)[0])
    return np.frombuffer(block, np.uint64, n, 8), np.frombuffer(block, np.uint32, n, 8 + 8 * n).astype(np.int64), np.frombuffer(block, np.uint64, n, 8 + 12 * n).astype(np.int64)


def merging(kind: str, decode: Callable, work: Callable, most: int | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task over rows of STATS sorted by kind and key: all blocks of a key together (or about `most` entries at once) go to
    work(key, arrays), whose rows go out; rows of other kinds pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, n = None, [], 0
        for batch in batches:
            mine = pc.equal(batch["kind"], kind)
            others = batch.filter(pc.invert(mine))
            if others.num_rows:
                yield others
            own = batch.filter(mine)
            for key, block in zip(own["key"].to_pylist(), own["block"], strict=True):
                if held and (key != now or (most and n >= most)):
                    parts, held, n = held, [], 0
                    yield stats_batch(work(now, [np.concatenate(x) for x in zip(*parts, strict=True)]))
                    del parts
                now = key
                held.append(decode(block.as_py()))
                n += len(held[-1][0])
        if held:
            yield stats_batch(work(now, [np.concatenate(x) for x in zip(*held, strict=True)]))

    return run


def fit(docs: DataFrame, learn: Column, order: int = ORDER) -> dict:
    """Counts the n-grams of the rows of docs(doc_id, text) where learn holds, and writes the model to the shared folder.

    Tasks sum grams of `order` of their tokens and send them in blocks, one for each shard of contexts (by way of groups of
    shards where there are many). A shard's task merges them into sorted arrays (keys of grams, counts; contexts with their
    totals and numbers of followers seen once, twice, more often) and sends on the grams without their first words: a shorter
    gram counts the different words seen in front of it, and one at a text's front, which has none, its occurrences. The last
    such step says in how many contexts each word stands. What comes back to the driver are sums: counts of counts and the
    totals of hot contexts. Nothing of the corpus is left out; the files grow with it, and with the order. An order under 2
    is refused. Contexts are the words of the text in front, as many as there are: a text shorter than the order has shorter ones.
    """
    if order < 2:
        raise ValueError("an n-gram has two tokens at least")
    spark = docs.sparkSession
    rows = docs.filter(learn).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    size = rows.agg(text_bytes(F.col("text"))).first()["bytes"]
    shards, folder, hot = int(size) // SHARD_BYTES + 4, new_folder(spark, "grams"), hot_contexts(rows, order)
    per, most = -(-shards // FAN), COUNT_TOKENS  # shards of a group
    groups = -(-shards // per)

    def to_shards(columns: list[np.ndarray]) -> np.ndarray:
        return gram_shards(gram_keys(columns[:-1]), columns[-1], shards, hot[len(columns)])

    def word_shards(word: np.ndarray) -> np.ndarray:
        return shard_of(word, shards).astype(np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, n = Hashes(), [], 0

        def blocks() -> pa.RecordBatch:
            flat, depth = joined(held)
            columns = grams_at(flat, np.flatnonzero(depth >= order - 1), order)
            _, first, c = np.unique(gram_keys(columns), return_index=True, return_counts=True)
            columns = [x[first] for x in columns]
            out = gram_blocks(columns, c, to_shards(columns) // per)
            for k in range(2, order):
                at = np.flatnonzero(depth == k - 1)
                _, *columns, c = added_grams(*grams_at(flat, at, k), np.ones(len(at), np.int64))
                out += gram_blocks(columns, c, to_shards(columns) // per)
            if order > 2:  # pairs count contexts then, not tokens
                word, c = np.unique(flat[depth > 0], return_counts=True)
                out += word_blocks(word, np.zeros(len(word), np.int64), c, word_shards(word) // per)
            return stats_batch(out)

        for batch in batches:
            for text in batch["text"]:
                t = tokens(text.as_py(), hashes)
                held.append(t)
                n += len(t)
                if n >= most:
                    yield blocks()
                    held, n = [], 0
        if held:
            yield blocks()

    def sent_on(_: int, found: list[np.ndarray]) -> list[tuple]:
        _, *columns, c = added_grams(*found)
        return gram_blocks(columns, c, to_shards(columns))

    def merge(shard: int, found: list[np.ndarray]) -> list[tuple]:
        keys, *columns, c = added_grams(*found)
        k, context, w = len(columns), gram_keys(columns[:-1]), columns[-1]
        own, total, *seen = summed(context, c, *[(c == x).astype(np.int64) for x in (1, 2)], (c > 2).astype(np.int64))
        spread = np.isin(own, hot[k])
        write_arrays(f"{folder}/{k}-{shard}", keys, own[~spread], *[x[~spread] for x in (total, *seen)], narrow(c))
        out = [(f"counts of {k}", 0, None, *of_counts(c))]
        out += [(f"hot of {k}", int(h.view(np.int64)), None, *(int(x) for x in row)) for h, *row in zip(own[spread], *[x[spread] for x in (total, *seen)], strict=True)]
        if k > 2:
            _, *columns, n = added_grams(*columns[1:], np.ones(len(w), np.int64))
            return out + gram_blocks(columns, n, to_shards(columns) // per)
        word, contexts, n = summed(w, np.ones(len(w), np.int64), c if order == 2 else np.zeros(len(w), np.int64))
        return out + word_blocks(word, contexts, n, word_shards(word) // per)

    def words_sent_on(_: int, found: list[np.ndarray]) -> list[tuple]:
        word, contexts, n = summed(*found)
        return word_blocks(word, contexts, n, word_shards(word))

    def gather(shard: int, found: list[np.ndarray]) -> list[tuple]:
        word, contexts, n = summed(*found)
        write_arrays(f"{folder}/words-{shard}", word, n, narrow(contexts))
        return [("contexts", 0, None, *of_counts(contexts)), ("totals", 0, None, len(word), int(n.sum()), int(contexts.sum()), 0)]

    def sent(df: DataFrame, kind: str, decode: Callable, group: Callable, shard: Callable) -> DataFrame:
        """Blocks of a kind to their shards' tasks, by way of groups where there are many shards."""
        if per > 1:
            dealt = df.withColumn("part", F.spark_partition_id() % PARTS).repartition(groups, "kind", "key", "part")
            df = dealt.sortWithinPartitions("kind", "key").drop("part").mapInArrow(merging(kind, decode, group, most), STATS)
        own = F.pmod("key", F.lit(shards)).cast("int")  # a shard a task: hashes of shards would meet
        return df.repartitionById(shards, own).sortWithinPartitions("kind", "key").mapInArrow(merging(kind, decode, shard), STATS)

    counted = rows.mapInArrow(count, STATS)
    for k in range(order, 1, -1):
        counted = sent(counted, grams(k), lambda block, k=k: grams_of(block, k), sent_on, merge)
    sums = sent(counted, "words", words_of, words_sent_on, gather).groupBy("kind", "key").agg(*[F.sum(x).alias(x) for x in "abcd"]).collect()
    one = {r["kind"]: [r[x] for x in "abcd"] for r in sums if not r["kind"].startswith("hot")}
    stats = {k: {r["key"] & (1 << 64) - 1: [r[x] for x in "abcd"] for r in sums if r["kind"] == f"hot of {k}"} for k in hot}
    words, train_tokens, pairs, _ = one.get("totals", [0, 0, 0, 0])
    once, twice, *_ = found = one.get("contexts", [0] * 4)
    word_discounts = discounts(found)
    left = word_discounts[0] * once + word_discounts[1] * twice + word_discounts[2] * (words - once - twice)
    return {
        "folder": folder, "shards": shards, "order": order, "hot": hot, "hot_keys": {k: np.array(sorted(x), np.uint64) for k, x in stats.items()},
        "hot_stats": {k: np.array([x[key] for key in sorted(x)], np.int64).reshape(-1, 4) for k, x in stats.items()},
        "discounts": {k: discounts(one.get(f"counts of {k}", [0] * 4)) for k in hot}, "word_discounts": word_discounts, "word_left": left,
        "words": words, "tokens": train_tokens, "pairs": pairs,
    }


def discounts(n: list[int]) -> list[float]:
    """Chen and Goodman's three discounts from counts of counts 1 to 4; a half each where one of the counts is missing.

    None is under 0.01, so that every context leaves something to words that it wasn't seen with.
    """
    if 0 in n:
        return [0.5, 0.5, 0.5]
    y = n[0] / (n[0] + 2 * n[1])
    return [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.01), float(k)) for k in (1, 2, 3)]


def discounted(c: np.ndarray, d: list[float]) -> np.ndarray:
    return c - np.array([0.0, *d])[np.minimum(c, 3)]


class Scorer:
    """Probabilities from the mapped arrays of a model."""

    def __init__(self, model: dict):
        self.m = m = model
        self.mapped = lru_cache(maxsize=200)(self.open)
        self.d = m["word_discounts"]
        # what the discounts leave goes to the uniform distribution over the words and one unknown
        self.back = m["word_left"] / max(m["pairs"], 1) / (m["words"] + 1)

    def open(self, kind: str | int, shard: int) -> list[np.ndarray]:
        path = f"{self.m['folder']}/{kind}-{shard}"
        if not os.path.exists(path):
            return []
        return map_arrays(path, "<u8", "<i8") if kind == "words" else map_arrays(path, "<u8", "<u8", "<i8", "<i8", "<i8", "<i8")

    @staticmethod
    def find(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the asked are in sorted keys, and which of them are there."""
        at = np.minimum(np.searchsorted(keys, asked), max(len(keys) - 1, 0))
        return at, keys[at] == asked if len(keys) else np.zeros(len(asked), bool)

    def word_counts(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of sorted words: tokens, and contexts."""
        out = np.zeros((2, len(words)), np.int64)
        for shard, a, b in slices(shard_of(words, self.m["shards"])):
            if arrays := self.mapped("words", shard):
                at, there = self.find(arrays[0], words[a:b])
                out[0, a:b], out[1, a:b] = np.where(there, arrays[1][at], 0), np.where(there, arrays[2][at], 0)
        return out[0], out[1]

    def context_counts(self, k: int, contexts: np.ndarray) -> np.ndarray:
        """Of sorted contexts of grams of k: what they count in all, and followers that count one, two, more."""
        out = np.zeros((4, len(contexts)), np.int64)
        for shard, a, b in slices(shard_of(contexts, self.m["shards"])):
            if arrays := self.mapped(k, shard):
                at, there = self.find(arrays[1], contexts[a:b])
                if there.any():
                    for j in range(4):
                        out[j, a:b] = np.where(there, arrays[2 + j][at], 0)
        at, there = self.find(self.m["hot_keys"][k], contexts)
        if there.any():
            out[:, there] = self.m["hot_stats"][k][at[there]].T
        return out

    def gram_counts(self, k: int, keys: np.ndarray, context: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Of grams of k whose keys are sorted."""
        to = gram_shards(context, w, self.m["shards"], self.m["hot"][k])
        order, out = np.argsort(to, kind="stable"), np.zeros(len(keys), np.int64)
        for shard, a, b in slices(to[order]):
            if arrays := self.mapped(k, shard):
                own = order[a:b]
                at, there = self.find(arrays[0], keys[own])
                out[own] = np.where(there, arrays[6][at], 0)
        return out

    def __call__(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text (hashes): known tokens, base score, score."""
        m = self.m
        flat, depth = joined(texts)
        at = np.flatnonzero(depth > 0)
        starts = np.flatnonzero(depth[at] == 1)
        words, word_at = np.unique(flat[at], return_inverse=True)
        n, in_contexts = self.word_counts(words)
        base = np.log10((n + 1) / (m["tokens"] + m["words"] + 1))
        if not m["pairs"]:  # nothing was learned: one unknown word
            low = np.ones(len(words))
        else:
            low = discounted(in_contexts, self.d) / m["pairs"] + self.back
        p = low[word_at]
        for k in range(2, m["order"] + 1):
            own = np.flatnonzero(depth[at] >= k - 1)
            *context, w = grams_at(flat, at[own], k)
            context = gram_keys(context)
            keys, first, gram_at = np.unique(pair_keys(context, w), return_index=True, return_inverse=True)
            contexts, context_at = np.unique(context[first], return_inverse=True)
            total, once, twice, more = self.context_counts(k, contexts)
            d, seen = m["discounts"][k], np.maximum(total, 1)
            left = np.where(total > 0, (d[0] * once + d[1] * twice + d[2] * more) / seen, 1.0)
            found = discounted(self.gram_counts(k, keys, context[first], w[first]), d) / seen[context_at]
            p[own] = found[gram_at] + left[context_at][gram_at] * p[own]
        known = np.add.reduceat((n > 0)[word_at].astype(np.int64), starts)
        return known, np.add.reduceat(base[word_at], starts), np.add.reduceat(np.log10(p), starts)


def slices(shards: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Runs of equal values: value, start, end."""
    cuts = np.flatnonzero(np.diff(shards.astype(np.int64))) + 1
    for a, b in zip([0, *cuts], [*cuts, len(shards)], strict=True):
        if a < b:
            yield int(shards[a]), int(a), int(b)


def score(docs: DataFrame, model: dict) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_tokens, n_known, base_score, score: log10 probabilities of whole texts.

    A text's tokens are its words and one end (null and empty texts: the end alone). base_score is that of unigrams with
    one added to each count. Whole texts count, however long; repeated rows score alike, null ids stay, an empty training set
    gives every token probability 1; an empty table gives no rows; other columns of docs, whatever their names, are left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, hashes = Scorer(shared.value), Hashes()
        for batch in batches:
            held, n, out, sizes = [], 0, [], []

            for text in batch["text"]:
                held.append(tokens(text.as_py(), hashes))
                sizes.append(len(held[-1]) - 1)
                n += sizes[-1]
                if n >= SCORE_TOKENS:
                    out.append(scorer(held))
                    held, n = [], 0
            if held:
                out.append(scorer(held))
            if out:
                yield pa.record_batch([batch["doc_id"], pa.array(sizes, pa.int64()), *[pa.array(np.concatenate(x)) for x in zip(*out, strict=True)]], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def op4_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, to six decimals, by a model of those whose crc32 mod 7 isn't 2."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    held = fold(F.col("doc_id"), 7) == 2
    model = fit(docs, ~held)
    scored = score(docs, model)
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(model["tokens"]).cast("long").alias("train_tokens"), F.round("base_score", 6).alias("base_score"), F.round("score", 6).alias("score"))


OP4_SQL = f"""
WITH {FOLD_SQL},
d AS (
  SELECT row_number() OVER () AS r, doc_id, crc % 7 = 2 AS held_out,
         list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), ' end') AS w
  FROM documents JOIN folds USING (doc_id)),
t AS (SELECT r, held_out, unnest(w) AS w, unnest(list_concat([' front'], w[:-2])) AS u FROM d),
pairs AS (SELECT u, w, count(*) AS c FROM t WHERE NOT held_out GROUP BY u, w),
words AS (SELECT w, sum(c) AS n, count(*) AS contexts FROM pairs GROUP BY w),
contexts AS (SELECT u, sum(c) AS total, count(*) FILTER (WHERE c = 1) AS once, count(*) FILTER (WHERE c = 2) AS twice, count(*) FILTER (WHERE c > 2) AS more FROM pairs GROUP BY u),
of_pairs AS (SELECT count(*) FILTER (WHERE c = 1) AS n1, count(*) FILTER (WHERE c = 2) AS n2, count(*) FILTER (WHERE c = 3) AS n3, count(*) FILTER (WHERE c = 4) AS n4 FROM pairs),
of_words AS (SELECT count(*) FILTER (WHERE contexts = 1) AS n1, count(*) FILTER (WHERE contexts = 2) AS n2, count(*) FILTER (WHERE contexts = 3) AS n3, count(*) FILTER (WHERE contexts = 4) AS n4 FROM words),
kinds AS (SELECT 'p' AS kind, * FROM of_pairs UNION ALL SELECT 'w', * FROM of_words),
discounts AS (
  SELECT kind, CASE WHEN least(n1, n2, n3, n4) = 0 THEN [0.5, 0.5, 0.5] ELSE
    [least(greatest(1 - 2 * y * n2 / n1, 0.01), 1), least(greatest(2 - 3 * y * n3 / n2, 0.01), 2), least(greatest(3 - 4 * y * n4 / n3, 0.01), 3)] END AS d
  FROM (SELECT *, n1::DOUBLE / (n1 + 2 * n2) AS y FROM kinds)),
p AS (SELECT d FROM discounts WHERE kind = 'p'), q AS (SELECT d FROM discounts WHERE kind = 'w'),
sums AS (
  SELECT sum(n) AS tokens, count(*) AS v, sum(contexts) AS pairs,
         sum(CASE contexts WHEN 1 THEN d[1] WHEN 2 THEN d[2] ELSE d[3] END) / sum(contexts) / (count(*) + 1) AS back
  FROM words, q),
asked AS (SELECT DISTINCT u, w FROM t),
scored AS (
  SELECT a.u, a.w, coalesce(words.n, 0) AS n, log10((coalesce(words.n, 0) + 1)::DOUBLE / (tokens + v + 1)) AS base,
         log10(coalesce((c - CASE c WHEN 1 THEN p.d[1] WHEN 2 THEN p.d[2] ELSE p.d[3] END) / total, 0)
               + coalesce((p.d[1] * once + p.d[2] * twice + p.d[3] * more) / total, 1)
                 * (coalesce(words.contexts - CASE words.contexts WHEN 1 THEN q.d[1] WHEN 2 THEN q.d[2] ELSE q.d[3] END, 0) / pairs + back)) AS score
  FROM asked a LEFT JOIN pairs x ON a.u = x.u AND a.w = x.w LEFT JOIN contexts k ON a.u = k.u LEFT JOIN words ON a.w = words.w, p, q, sums),
totals AS (
  SELECT r, count(*) AS n_tokens, count(*) FILTER (WHERE n > 0) AS n_known, sum(base) AS base_score, sum(score) AS score
  FROM t JOIN scored USING (u, w) GROUP BY r)
SELECT doc_id, held_out, n_tokens, n_known, CAST(tokens AS BIGINT) AS train_tokens, round(base_score, 6) AS base_score, round(score, 6) AS score
FROM d JOIN totals USING (r), sums
"""
