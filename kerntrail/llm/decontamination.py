"""Benchmark decontamination: one Aho-Corasick automaton over the normalised windows of the test items, one scan of each text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load

WINDOW = 13
#: Most nodes of one automaton (about 65 bytes each, with the windows' owners): a window has DIGITS for each word. Items beyond it go to
#: further automata, which a task builds one at a time.
NODES, DIGITS = 2_000_000, 3
#: Bytes of rows that a task holds while each of several automata scans them in turn.
BLOCK_BYTES = 64 << 20
#: Every byte of a text: letters in lower case, digits and bytes of other scripts as they are, all else a space.
NORMAL = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
SPAN = re.compile(rb"[^ ]+")


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(NORMAL).split()


def windows(words: list[int], width: int) -> list[tuple[int, ...]]:
    return [tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []


class Scanner:
    """The automaton over windows of items, (id as text or None, text).

    Its letters are digits, to the base 32, of the numbers of the items' words: so a node has few ways on, however many words there
    are. Each place of a number has letters of its own, so that windows are found where words begin alone; zeros are any other word.
    """

    def __init__(self, items: list[tuple[str | None, str | None]], width: int = WINDOW):
        number: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set] = {}
        for key, text in items:
            for window in windows([number.setdefault(w, len(number)) for w in normal_words(text)], width):
                owners.setdefault(window, set()).add(key)
        self.digits = next(d for d in range(DIGITS, 13) if len(number) <= 32**d)
        codes = ["".join(chr(32 * (p + 1) + (k >> 5 * p & 31)) for p in range(self.digits)) for k in range(len(number))]
        self.code, self.other = dict(zip(number, codes, strict=True)), "\0" * self.digits
        self.values = [(len(window), frozenset(k for k in keys if k is not None)) for window, keys in owners.items()]
        self.automaton = ahocorasick.Automaton()
        for k, window in enumerate(owners):
            self.automaton.add_word("".join([codes[n] for n in window]), k)
        if owners:
            self.automaton.make_automaton()

    def scan(self, words: list[bytes]) -> list[tuple[int, int, int]]:
        """For each occurrence its first word, the word behind it and the window's number."""
        if not words or not self.values:
            return []
        found = list(self.automaton.iter("".join(map(self.code.get, words, repeat(self.other)))))
        return [((behind := end // self.digits + 1) - self.values[v][0], behind, v) for end, v in found]


def covered(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of half-open intervals, as sorted disjoint ones."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(intervals):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def original(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of words as spans of characters of the text itself."""
    raw = text.encode()
    at = np.array([m.span() for m in SPAN.finditer(raw.translate(NORMAL))])
    spans = np.array([(at[a, 0], at[b - 1, 1]) for a, b in runs])
    if len(raw) > len(text):  # characters in front of each byte
        spans = np.append(0, np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80))[spans]
    return [(int(a), int(b)) for a, b in spans]


def blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[pa.RecordBatch]]:
    """The batches in lists of about `most` bytes."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def scanned(batches: Iterator[pa.RecordBatch], shared: list[Broadcast], width: int) -> Iterator[tuple[pa.RecordBatch, list[tuple[int, list[tuple[int, int]], set[str]]]]]:
    """Each batch with its rows' numbers of words, runs of hit words and items, by the automata of all chunks of items.

    A row's findings are united here, so that rows need no key. One automaton serves all batches; several are built in
    turn for each block.
    """
    only = Scanner(shared[0].value, width) if len(shared) == 1 else None
    for block in blocks(batches, 0 if only else BLOCK_BYTES):
        rows = [[(0, [], set()) for _ in range(batch.num_rows)] for batch in block]
        for chunk in shared:
            scanner = None  # the one before makes room
            scanner = only or Scanner(chunk.value, width)
            for batch, own in zip(block, rows, strict=True):
                for i, text in enumerate(batch["text"]):
                    words = normal_words(text.as_py())
                    found = scanner.scan(words)
                    _, runs, owners = own[i]
                    if found:
                        runs = covered([*runs, *((a, b) for a, b, _ in found)])
                        owners.update(*(scanner.values[v][1] for _, _, v in found))
                    own[i] = len(words), runs, owners
        yield from zip(block, rows, strict=True)


def contains(docs: DataFrame, items: DataFrame, width: int = WINDOW) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_words, runs of hit words (first, behind), spans in the text (characters), items.

    A word is hit if it stands inside any occurrence of a window of `width` consecutive item words (an item of fewer words,
    but not none, is one window). Null and empty texts have no words; null ids of items count for hits and aren't listed;
    repeated items count once; without items nothing is hit. Each row is judged by its own text, however many automata
    the items need. Very long texts are scanned whole; an empty table of docs gives no rows. Other columns of docs, whatever
    their names, are left out.
    """
    schema = "doc_id long, n_words long, runs array<struct<first:int,behind:int>>, spans array<struct<first:int,behind:int>>, items array<string>"
    kind = pa.list_(pa.struct([("first", pa.int32()), ("behind", pa.int32())]))
    shared = broadcast_chunks(items, width)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows in scanned(batches, shared, width):
            n, runs, owners = [x[0] for x in rows], [x[1] for x in rows], [sorted(x[2]) for x in rows]
            spans = [original(text.as_py(), x) if x else [] for text, x in zip(batch["text"], runs, strict=True)]
            pairs = [pa.array([[{"first": a, "behind": b} for a, b in x] for x in xs], kind) for xs in (runs, spans)]
            yield pa.record_batch([batch["doc_id"], pa.array(n, pa.int64()), *pairs, pa.array(owners, pa.list_(pa.string()))], ["doc_id", "n_words", "runs", "spans", "items"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, schema)


def item_chunks(items: DataFrame, width: int = WINDOW, nodes: int = NODES) -> Iterator[list[tuple[str | None, str | None]]]:
    """The items in lists whose windows take at most `nodes` nodes together; an item beyond that is cut between windows.

    Items are a test set: they pass the driver one at a time, and their chunks, not more than its text, go to all workers.
    """
    rows = items.select(F.col("item_id").cast("string").alias("item_id"), "text").distinct()
    most, held, size = max(1, nodes // (width * DIGITS)), [], 0
    for key, text in rows.toLocalIterator():
        words = normal_words(text)
        for a in range(0, max(1, len(words) - width + 1), most):
            piece = words[a : a + most + width - 1]
            n = max(1, len(piece) - width + 1)
            if held and size + n > most:
                yield held
                held, size = [], 0
            held.append((key, b" ".join(piece).decode()))
            size += n
    yield held


def broadcast_chunks(items: DataFrame, width: int = WINDOW) -> list[Broadcast]:
    return [items.sparkSession.sparkContext.broadcast(chunk) for chunk in item_chunks(items, width, NODES)]


def contaminated(n_words, n_hit):
    """The rule: any hit, and hits in a twentieth of the words at least."""
    return (n_hit > 0) & (n_hit * 20 >= n_words)


def hit_words(runs):
    return F.aggregate(runs, F.lit(0).cast("long"), lambda acc, x: acc + x["behind"] - x["first"])


def decontaminate(docs: DataFrame, items: DataFrame, width: int = WINDOW) -> DataFrame:
    """The documents that aren't contaminated, with all their columns; the text is scanned beside them in one pass.

    Null ids, repeated rows and clashing columns stay as they are: each row is judged by its own text. Null and empty texts
    have no words and stay; without documents or without items nothing is taken away.
    """
    shared = broadcast_chunks(items, width)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows in scanned(batches, shared, width):
            hits = [(n, sum(b - a for a, b in runs)) for n, runs, _ in rows]
            yield batch.filter(pa.array([not (hit and 20 * hit >= n) for n, hit in hits], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, hit words and items found in every document, whether it is contaminated, and where in its text: spans of characters `first-behind`."""
    found = contains(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    found = found.withColumn("n_hit", hit_words(F.col("runs")))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["first"].cast("string"), s["behind"].cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), contaminated(F.col("n_words"), F.col("n_hit")).alias("contaminated"), spans.alias("spans"))


OP2_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT item_id, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i, w FROM b WHERE len(w) > 0),
bk AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + 12], ' ') AS k FROM bw),
ns AS (SELECT DISTINCT n FROM bk),
dk AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n)),
hits AS (SELECT doc_id, item_id, i, dk.n AS n FROM dk JOIN bk USING (n, k)),
hit AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS j FROM hits),
spread AS (SELECT doc_id, count(*) AS n_hit FROM hit GROUP BY doc_id),
pieces AS (
  SELECT doc_id, unnest(p) AS piece, unnest(range(1, len(p) + 1)) AS k
  FROM (SELECT doc_id, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+|[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS p FROM documents SEMI JOIN spread USING (doc_id))),
placed AS (
  SELECT doc_id, length(piece) AS n, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY k) AS behind,
         regexp_matches(piece, '^[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]') AS word, k FROM pieces),
numbered AS (SELECT doc_id, behind - n AS first, behind, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS j FROM placed WHERE word),
islands AS (SELECT doc_id, j, j - row_number() OVER (PARTITION BY doc_id ORDER BY j) AS island FROM hit),
runs AS (SELECT doc_id, CAST(min(first) AS BIGINT) AS first, CAST(max(behind) AS BIGINT) AS behind FROM islands JOIN numbered USING (doc_id, j) GROUP BY doc_id, island),
spans AS (SELECT doc_id, string_agg(first || '-' || behind, ',' ORDER BY first) AS spans FROM runs GROUP BY doc_id),
listed AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated,
       coalesce(spans, '') AS spans
FROM d LEFT JOIN spread USING (doc_id) LEFT JOIN listed USING (doc_id) LEFT JOIN spans USING (doc_id)
"""
