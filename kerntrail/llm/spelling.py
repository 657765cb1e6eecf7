"""Spelling variants: words one edit apart, found by comparing tiles of padded code-point matrices by common prefixes and suffixes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, staged

RUN = r"[A-Za-zÀ-ÿ]+"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word is cut into so many pieces; an edit touches one of them, so near words share all but one.
PIECES = 3
#: Words of a key beyond which the key's piece is cut into single code points.
HOT = 2048
#: Words of a tile, and code points of the two matrices and comparisons that a tile pair may take.
TILE, CELLS = 128, 4 << 20
#: Most hot keys that are broadcast (40 bytes each).
BROADCAST_KEYS = 1_000_000
#: Rounds of pointer doubling: forms' numbers grow tenfold at each step, and a long ends below 10^19, so chains have under 32 steps.
DOUBLINGS = 5


def runs_of(docs: DataFrame, least: int = 7, every: int = 31) -> DataFrame:
    """docs(doc_id, text) -> word, a row for each occurrence of `least` code points or more.

    Runs of Latin letters, A-Z in lower case; where `every` divides the crc32 of `id:run` the code point at crc32 % length is deleted.
    """
    run = F.explode(F.regexp_extract_all(F.translate(F.col("text"), CAPITALS, SMALL), F.lit(RUN), F.lit(0)))
    h = F.crc32(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("run")))
    rows = docs.select("doc_id", run.alias("run")).filter(F.char_length("run") >= least).withColumn("h", h)
    n, at = F.char_length("run"), F.pmod("h", F.char_length("run").cast("long")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring(F.col("run"), at + 2, n))
    return rows.select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("run")).alias("word")).filter(F.char_length("word") >= least)


def bounds(m: Column, piece: int | Column) -> Column:
    """Where a piece of a word of m code points begins."""
    return F.floor(m * piece / PIECES).cast("int")


def key_of(m: Column, a: Column, b: Column) -> Column:
    """The key of words that share what stands before a, and after b counted in a word of m code points: two hashes, 128 bits."""
    n = F.char_length("word")
    front, back = F.substring(F.col("word"), F.lit(1), a), F.substring(F.col("word"), n - (m - b) + 1, m - b)
    parts = [m, a, b, front, back]
    return F.struct(F.xxhash64(*parts).alias("k1"), F.xxhash64(F.lit("second"), *parts).alias("k2"))


def keyed(words: DataFrame) -> DataFrame:
    """words(word, n) -> word, n, m, a, b, k: each word as one of m code points and as one of m + 1, for each piece [a, b) that an edit may touch."""
    n = F.char_length("word")
    as_m = words.withColumn("m", F.explode(F.array(n, n - 1)))
    pieces = as_m.withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(PIECES - 1))))
    cut = pieces.withColumns({"a": bounds(F.col("m"), F.col("piece")), "b": bounds(F.col("m"), F.col("piece") + 1)})
    cut = cut.filter("a < b")
    return cut.withColumn("k", key_of(F.col("m"), F.col("a"), F.col("b"))).select("word", "n", "m", "a", "b", "k")


def split_hot(rows: DataFrame, hot: int) -> DataFrame:
    """Rows of keys with over `hot` words under longer keys: one for each code point of the piece, all others being shared.

    Words of m code points under such a key differ in one place, those of m + 1 in two: few, whatever the key had.
    """
    large = staged(rows.groupBy("k").count().filter(F.col("count") > hot).select("k"), "hot-keys")
    found = large.count()
    if not found:
        return rows
    marked = large.select(F.col("k").alias("large"))
    marked = F.broadcast(marked) if found <= BROADCAST_KEYS else marked
    rows = rows.join(marked, F.col("k") == F.col("large"), "left")
    places = F.when(F.col("large").isNull(), F.array(F.lit(-1))).otherwise(F.sequence(F.col("a"), F.col("b") - 1))
    rows = rows.withColumn("place", F.explode(places))
    a, b = F.when(F.col("place") < 0, F.col("a")).otherwise(F.col("place")), F.when(F.col("place") < 0, F.col("b")).otherwise(F.col("place") + 1)
    rows = rows.withColumns({"a": a, "b": b})
    return rows.withColumn("k", F.when(F.col("place") < 0, F.col("k")).otherwise(key_of(F.col("m"), F.col("a"), F.col("b")))).drop("place", "large")


def code_points(words: list[str], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words as a matrix padded to the right by 0, as one padded to the left, and their lengths."""
    length = np.array([len(w) for w in words])
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    column = np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)
    row = np.repeat(np.arange(len(words)), length)
    left, right = np.zeros((len(words), width), np.uint32), np.zeros((len(words), width), np.uint32)
    left[row, column] = flat
    right[row, column + width - np.repeat(length, length)] = flat
    return left, right, length


def agreement(x: np.ndarray, y: np.ndarray, columns: Iterator[int]) -> np.ndarray:
    """For each row of x and each of y in how many of the columns, from the first on, they agree."""
    alike = np.ones((len(x), len(y)), bool)
    out = np.zeros((len(x), len(y)), np.int32)
    for c in columns:
        alike &= x[:, c, None] == y[None, :, c]
        if not alike.any():
            break
        out += alike
    return out


def near(x: tuple, y: tuple, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Which words of tile x (rows) are one edit from which of tile y (columns), all of m or m + 1 code points, and the first place of the edit.

    Common prefix and suffix together reach the longer length less one, and of one length or not, the words aren't equal.
    """
    width = x[0].shape[1]
    length = np.maximum(x[2][:, None], y[2][None, :])
    uneven = x[2][:, None] != y[2][None, :]
    prefix = agreement(x[0], y[0], range(width))
    suffix = agreement(x[1], y[1], range(width - 1, -1, -1))
    shorter = np.minimum(x[2][:, None], y[2][None, :])
    prefix, suffix = np.minimum(prefix, shorter), np.minimum(suffix, shorter)
    fits = (prefix + suffix >= length - 1) & (uneven | (prefix < length)) & (shorter == m)
    return fits, np.where(uneven, shorter - suffix, prefix)


class Best:
    """Near words' numbers and the best of them, for the rows of one batch of tiles."""

    def __init__(self):
        self.words: list[str] = []
        self.counts: list[int] = []
        self.forms: list[tuple[int, str]] = []

    def add(self, words: list[str], ns: np.ndarray, others: list[str], other_ns: np.ndarray, hits: np.ndarray) -> None:
        """hits: which of the words (rows) are near which of the others (columns)."""
        many = hits.sum(axis=1)
        for i in np.flatnonzero(many).tolist():
            js = np.flatnonzero(hits[i])
            top = other_ns[js].max()
            self.words.append(words[i])
            self.counts.append(int(many[i]))
            self.forms.append((int(top), min(others[j] for j in js[other_ns[js] == top].tolist())))

    def batch(self) -> pa.RecordBatch:
        columns = [pa.array(self.words, pa.string()), pa.array(self.counts, pa.int64()), pa.array([n for n, _ in self.forms], pa.int64()), pa.array([w for _, w in self.forms], pa.string())]
        self.__init__()
        return pa.record_batch(columns, ["word", "n_near", "near_n", "near"])


def tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by m and key are met in tiles; a tile meets itself and the earlier ones that its keys began in.

    Only words with one key are compared; of two near words' keys the one whose piece holds the edit's first place counts.
    """
    held: list[tuple] = []  # the tiles that a later row of the last key must meet
    best = Best()

    def meet(one: tuple, two: tuple, same: bool) -> None:
        m = one[4]
        hits, place = near(one[1], two[1], m)
        a, b = one[5][:, None], one[6][:, None]
        place = np.minimum(place, m - 1)
        hits &= (one[3][:, None] == two[3][None, :]) & (a <= place) & (place < b)
        best.add(one[0], one[2], two[0], two[2], hits)
        if not same:
            best.add(two[0], two[2], one[0], one[2], hits.T)

    for words, ns, keys, m, a, b in tiles(batches):
        tile = (words, code_points(words, m + 1), ns, keys, m, a, b)
        held = [t for t in held if t[4] == m and t[3][-1] == keys[0]]
        for earlier in held:
            meet(earlier, tile, False)
        meet(tile, tile, True)
        if len(set(keys.tolist())) > 1:
            held = []
        held.append(tile)
        if len(best.words) > 10_000:
            yield best.batch()
    if best.words:
        yield best.batch()


def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(words, their numbers, keys, m, a, b) for up to TILE rows of one m at a time; fewer where words are long."""
    words, ns, keys, a, b, m = [], [], [], [], [], None

    def tile():
        return words, np.array(ns, np.int64), np.array(keys, np.int64), m, np.array(a, np.int32), np.array(b, np.int32)

    number, last = 0, None
    for batch in batches:
        k = batch["k"]
        rows = zip(batch["word"].to_pylist(), batch["n"].to_pylist(), batch["m"].to_pylist(), batch["a"].to_pylist(), batch["b"].to_pylist(), zip(k.field("k1").to_pylist(), k.field("k2").to_pylist(), strict=True), strict=True)
        for word, n, as_m, first, behind, key in rows:
            if words and (as_m != m or len(words) >= max(1, min(TILE, CELLS // (m + 1)))):
                yield tile()
                words, ns, keys, a, b = [], [], [], [], []
            if (as_m, key) != last:
                number, last = number + 1, (as_m, key)
            m = as_m
            for column, value in zip((words, ns, keys, a, b), (word, n, number, first, behind), strict=True):
                column.append(value)
    if words:
        yield tile()


def near_words(words: DataFrame, hot: int = HOT) -> DataFrame:
    """words(word, n), distinct -> word, n_near, near_n, near: for words with a near one their number, the largest n of one and its word, ties to the least."""
    rows = split_hot(staged(keyed(words), "spelling-keys"), hot)
    dealt = rows.repartition("k").sortWithinPartitions("m", "k")
    found = dealt.mapInArrow(tiled, "word string, n_near long, near_n long, near string")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")  # the largest number, then the least word
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("best.less")).alias("near_n"), "best.near")


def roots(forms: DataFrame, doublings: int = DOUBLINGS) -> DataFrame:
    """forms(word, form) -> word, root: the last of the forms, by pointer doubling."""
    at = staged(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(doublings):
        then = at.select(F.col("word").alias("root"), F.col("root").alias("then"))
        joined = at.join(then, "root", "left")
        changed = staged(joined.select("word", F.coalesce("then", "root").alias("root"), F.col("then").isNotNull().alias("moved")), "roots")
        at = changed.select("word", "root")
        if changed.filter("moved").isEmpty():
            break
    return at


def variants(docs: DataFrame, least: int = 7, times: int = 10, every: int = 31, hot: int = HOT) -> DataFrame:
    """docs(doc_id, text) -> word, form, root, n, n_near, form_n for every word of `least` code points and two occurrences or more.

    Two words are near if one inserted, deleted or replaced code point makes one the other. A word's form is its near word of largest n
    (ties: the smallest in code-point order) if that is `times` its own n or more; its root follows forms to the last, and is the word itself
    without one. Null texts have no words, null ids count as the empty text; repeated rows count each; very long runs are words
    like others (one code point each a column of its matrices); without words there are no rows; other columns of docs, whatever
    their names, are left out. Keys of over `hot` words are cut finer, so no group grows with the words.
    """
    words = staged(runs_of(docs, least, every).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2"), "words")
    met = staged(words.join(near_words(words, hot), "word", "left"), "near")
    large = F.col("near_n") >= F.col("n") * times
    formed = met.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(large, F.col("near")).alias("form"), F.when(large, F.col("near_n")).alias("form_n"))
    found = roots(formed.filter("form is not null"))
    return formed.join(found, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of at least 7 code points and two occurrences with its form, root and number of near words."""
    return variants(load(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH RECURSIVE crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents),
counted AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS k, run, count(*) AS times FROM runs WHERE length(run) >= 7 GROUP BY ALL),
octets AS (
  SELECT run, times, flatten(list_transform(string_split(k, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)]
         ELSE [CAST(192 | (unicode(c) >> 6) AS BIGINT), CAST(128 | (unicode(c) & 63) AS BIGINT)] END)) AS o FROM counted),
hashed AS (
  SELECT run, times, xor(list_reduce(list_concat([4294967295], o), lambda a, b: xor(t[1 + (xor(a, b) & 255)], a >> 8)), 4294967295) AS h FROM octets, crc_table),
edited AS (
  SELECT CASE WHEN h % 31 = 0 THEN left(run, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, times FROM hashed),
words AS (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM edited WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2),
less AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
  SELECT a.word AS u, b.word AS v FROM less a JOIN less b USING (i, rest) WHERE a.word <> b.word
  UNION SELECT word, rest FROM less WHERE rest IN (SELECT word FROM words)
  UNION SELECT rest, word FROM less WHERE rest IN (SELECT word FROM words)),
best AS (
  SELECT u, count(*) AS n_near, first(v ORDER BY n DESC, v) AS near, max(n) AS near_n FROM pairs JOIN words ON v = word GROUP BY u),
formed AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * n THEN near END AS form, CASE WHEN near_n >= 10 * n THEN near_n END AS form_n
  FROM words LEFT JOIN best ON word = u),
chain AS (
  SELECT word, word AS root, 0 AS depth FROM formed
  UNION ALL SELECT chain.word, form, depth + 1 FROM chain JOIN formed ON chain.root = formed.word WHERE form IS NOT NULL)
SELECT word, form, (SELECT arg_max(root, depth) FROM chain WHERE chain.word = formed.word) AS root, n, n_near, form_n FROM formed
"""
