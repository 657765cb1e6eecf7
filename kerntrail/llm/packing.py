"""Token ids packed into fixed-length rows: best fit decreasing, with a segment tree over remaining capacities."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import REMEMBERED, load

CONTEXT = 2048
#: Tokens that are packed together: a task packs its documents in blocks of about so many.
BLOCK_TOKENS = 4 << 20
TOKENIZER = os.environ.get("KERNTRAIL_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: The pieces that byte-level BPE merges inside (a fixed value of the public vocabulary).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: No piece crosses the bounds of these, so that each is encoded once and remembered.
CHUNK = re.compile(r" ?\S+|\s+(?!\S)|\s+")


class Encoder(dict):
    """Texts as little-endian uint16 ids; remembers chunks."""

    MEMO = 1_000_000

    def __init__(self, path: str = TOKENIZER):
        super().__init__()
        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        if len(ranks) > 1 << 16:
            raise ValueError("ids of this vocabulary need more than 16 bits")
        self.own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __missing__(self, chunk: str) -> bytes:
        ids = np.array(self.own.encode_ordinary(chunk), "<u2").tobytes()
        if len(chunk) <= REMEMBERED:
            if len(self) >= self.MEMO:
                self.clear()
            self[chunk] = ids
        return ids

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, CHUNK.findall(text)))

    def decode(self, ids) -> str:
        return self.own.decode(np.asarray(ids).tolist())


class Capacities:
    """A segment tree over capacities 1 to n: how many open rows have each; finds the least capacity that is enough."""

    def __init__(self, n: int):
        self.size = 1 << n.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(n + 1)]

    def change(self, capacity: int, by: int) -> None:
        k = capacity + self.size
        while k:
            self.count[k] += by
            k >>= 1

    def add(self, capacity: int, row: int) -> None:
        self.rows[capacity].append(row)
        self.change(capacity, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """A row with the least capacity >= need, and that capacity."""
        k = need + self.size
        if not self.count[k]:
            while k > 1 and (k & 1 or not self.count[k + 1]):
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self.size:
                k = 2 * k if self.count[2 * k] else 2 * k + 1
        capacity = k - self.size
        self.change(capacity, -1)
        return self.rows[capacity].pop(), capacity


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Rows of item numbers: the longest first, each into the row with the least room that is enough. Ties: input order."""
    tree, rows = Capacities(capacity), []
    for item in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        need = lengths[item]
        row, room = tree.take(need) or (len(rows), capacity)
        if row == len(rows):
            rows.append([])
        rows[row].append(item)
        if room > need:
            tree.add(room - need, row)
    return rows


def pack_block(ids: list[np.ndarray], context: int) -> list[tuple[np.ndarray, list[int], list[int], list[int]]]:
    """The rows of a block: ids, and for each segment its document's number, its first token there, its end in the row."""
    parts = [(i, k, min(len(x), k + context)) for i, x in enumerate(ids) for k in range(0, len(x), context)]
    out = []
    for row in best_fit_decreasing([b - a for _, a, b in parts], context):
        own = [parts[p] for p in row]
        ends = np.cumsum([b - a for _, a, b in own]).tolist()
        out.append((np.concatenate([ids[i][a:b] for i, a, b in own]), [i for i, _, _ in own], [a for _, a, _ in own], ends))
    return out


SCHEMA = "block long, row int, n_tokens int, ids binary, positions binary, cu_seqlens array<int>, doc_ids array<long>, doc_starts array<int>"


def pack(docs: DataFrame, context: int = CONTEXT, tokenizer: str = TOKENIZER, pad: int = 0) -> DataFrame:
    """docs(doc_id, text) -> the rows of packed id matrices.

    ids: `context` little-endian uint16, of which n_tokens are tokens and the rest `pad`. positions: as many, each token's
    place in its segment, 0 in the padding. cu_seqlens: 0 and the end of each segment. doc_ids and doc_starts: whose tokens,
    from which token on; documents longer than a row are split and nothing is lost, however long they are. Null and empty texts
    have no tokens and no segment; repeated rows are packed each; null ids stay null; of equally long pieces the first comes
    first; an empty table gives no rows; other columns of docs, whatever their names, are left out. block: a task's documents of
    about BLOCK_TOKENS tokens, so that nothing is shuffled and a lost task is packed again; which documents share a
    block depends on how the table is split into tasks.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, names, ids, held, n = Encoder(tokenizer), [], [], 0, 0
        first = TaskContext.get().partitionId() << 32

        def packed():
            rows = pack_block(ids, context)
            columns = [
                pa.array([first + n] * len(rows), pa.int64()),
                pa.array(range(len(rows)), pa.int32()),
                pa.array([len(r[0]) for r in rows], pa.int32()),
                pa.array([x.tobytes() for x in matrix([r[0].tobytes() for r in rows], context, pad)], pa.binary()),
                pa.array([x.tobytes() for x in matrix([positions([0, *r[3]]).astype("<u2").tobytes() for r in rows], context)], pa.binary()),
                pa.array([[0, *r[3]] for r in rows], pa.list_(pa.int32())),
                pa.array([[names[i] for i in r[1]] for r in rows], pa.list_(pa.int64())),
                pa.array([r[2] for r in rows], pa.list_(pa.int32())),
            ]
            return pa.record_batch(columns, ["block", "row", "n_tokens", "ids", "positions", "cu_seqlens", "doc_ids", "doc_starts"])

        for batch in batches:
            for name, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                x = np.frombuffer(encoder.encode(text.as_py() or ""), "<u2")
                names.append(name)
                ids.append(x)
                held += len(x)
                if held >= BLOCK_TOKENS:
                    yield packed()
                    names, ids, held, n = [], [], 0, n + 1
        if held:
            yield packed()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, SCHEMA)


def matrix(ids: list[bytes], context: int = CONTEXT, pad: int = 0) -> np.ndarray:
    """Rows of uint16 as one matrix, padded to the right."""
    out = np.full((len(ids), context), pad, "<u2")
    for k, x in enumerate(ids):
        out[k, : len(x) // 2] = np.frombuffer(x, "<u2")
    return out


def positions(cu_seqlens: list[int]) -> np.ndarray:
    """The position of each token in its segment: 0 where a segment starts."""
    ends = np.asarray(cu_seqlens)
    return np.arange(ends[-1]) - np.repeat(ends[:-1], np.diff(ends))


def write(packed: DataFrame, path: str) -> None:
    """The matrices of ids and of positions with their segments as Parquet, a row for each of theirs, in order inside each file."""
    packed.write.mode("overwrite").parquet(path)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as packed rows: padded matrices of ids and positions, cumulative lengths, owners of segments."""
    return pack(load(spark, sf_dir, "documents"))
