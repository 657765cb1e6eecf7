"""Token counts by finite-state transducers: one cuts texts into words, its chunks' state maps composed by a parallel prefix scan; one merges bytes."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from tokenizers import Tokenizer

from .common import load, unused

TOKENIZER = os.environ.get("KERNTRAIL_TOKENIZER_JSON", "/opt/tokenizers/byte_bpe_50k.json")
LIMIT = 1024
#: Characters that are worked on together, and characters of a chunk, whose state map is one of the prefix scan's elements.
SLICE, CHUNK = 1 << 19, 64
#: Most states of the merging transducer (1 KB each); beyond it steps are worked out without being kept, and the next slice starts anew.
STATES = 1 << 17
#: Most pairs of tokens whose verdict is remembered.
PAIRS = 500_000
#: Words that outlast all but so many others are walked one by one.
FEW = 16


# kinds of characters, as the word pattern tells them apart
LETTER, NUMBER, SPACE, BLANK, OTHER, UNKNOWN, END = range(7)
# letters of the cutting transducer: kinds, and what the next two characters decide (a blank before a word, an apostrophe before 1 or 2 letters of an ending)
A_LETTER, A_NUMBER, A_OTHER, A_ONE, A_TWO, A_SPACE, A_BLANK, A_MIDDLE = range(8)
LETTERS = 8
# its states: where a word starts in any case; inside letters, numbers, others; behind a space that joins the next word; inside blanks; 1 or 2 letters of an ending left
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, JOINING, IN_BLANKS, LAST, LAST_BUT_ONE = range(8)
STATES_OF_CUT = 8


def cutting() -> tuple[np.ndarray, np.ndarray]:
    """The transducer that cuts: next state and whether a word starts, for each letter and state.

    Letters from LETTERS on are the same at the start of a text, which forgets the state; the last one changes nothing.
    """
    into = {A_LETTER: IN_LETTERS, A_NUMBER: IN_NUMBERS, A_OTHER: IN_OTHERS, A_ONE: LAST, A_TWO: LAST_BUT_ONE, A_SPACE: JOINING, A_BLANK: FRESH, A_MIDDLE: IN_BLANKS}
    goes = np.zeros((2 * LETTERS + 1, STATES_OF_CUT), np.uint8)
    starts = np.zeros((2 * LETTERS + 1, STATES_OF_CUT), bool)
    others = (A_OTHER, A_ONE, A_TWO)
    for letter, target in into.items():
        for state in range(STATES_OF_CUT):
            end, start = target, True
            if state == LAST_BUT_ONE:
                end, start = LAST, False
            elif state == LAST:
                end, start = FRESH, False
            elif (state, letter) in ((IN_LETTERS, A_LETTER), (IN_NUMBERS, A_NUMBER), (JOINING, A_LETTER), (JOINING, A_NUMBER), (IN_BLANKS, A_MIDDLE)):
                start = False
            elif state in (IN_OTHERS, JOINING) and letter in others:
                end, start = IN_OTHERS, False
            goes[letter, state], starts[letter, state] = end, start
            goes[LETTERS + letter, state], starts[LETTERS + letter, state] = target, True
    goes[2 * LETTERS] = np.arange(STATES_OF_CUT)
    return goes, starts


GOES, STARTS = cutting()
KEEP = 2 * LETTERS


def prefix_scan(maps: np.ndarray) -> np.ndarray:
    """Row i: the composition of the state maps of rows 0 to i, the first applied first; log2 of the rows' number steps, each on all rows at once."""
    maps, shift = maps.copy(), 1
    while shift < len(maps):
        maps[shift:] = np.take_along_axis(maps[shift:], maps[:-shift], 1)
        shift *= 2
    return maps


def cut(letters: np.ndarray, state: int) -> tuple[np.ndarray, int]:
    """For each letter whether a word starts there, and the state behind the last one."""
    n, rows = len(letters), -(-len(letters) // CHUNK)
    columns = np.full(rows * CHUNK, KEEP, np.uint16)
    columns[:n] = letters
    columns = np.ascontiguousarray(columns.reshape(rows, CHUNK).T) * STATES_OF_CUT
    goes, starts = GOES.ravel(), STARTS.ravel()
    maps = np.tile(np.arange(STATES_OF_CUT, dtype=np.uint8), (rows, 1))
    for column in columns:  # each chunk's map of all states
        maps = goes[column[:, None] + maps]
    whole = prefix_scan(maps)
    at = np.empty(rows, np.uint8)
    at[0], at[1:] = state, whole[:-1, state]
    out = np.empty((CHUNK, rows), bool)
    for k, column in enumerate(columns):
        out[k] = starts[column + at]
        at = goes[column + at]
    return out.T.ravel()[:n], int(whole[-1, state])


class Kinds:
    """The kinds of characters as the library's own word pattern sees them, asked once for each character that occurs."""

    def __init__(self, splitter):
        self.splitter, self.table = splitter, np.full(0x110000, UNKNOWN, np.uint8)
        self.table[0x20] = SPACE

    def alone(self, around: str, c: str) -> bool:
        return len(self.splitter.pre_tokenize_str(around + c + around)) == 1

    def of(self, codes: np.ndarray) -> np.ndarray:
        found = self.table[codes]
        if (found == UNKNOWN).any():
            for code in np.unique(codes[found == UNKNOWN]).tolist():
                c = chr(code)
                self.table[code] = LETTER if self.alone("a", c) else NUMBER if self.alone("1", c) else OTHER if self.alone("!", c) else BLANK
            found = self.table[codes]
        return found


def letters_of(codes: np.ndarray, kinds: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The cutting transducer's letters; ends: places of the last characters of texts."""
    then = np.append(kinds[1:], END).astype(np.uint8)
    then[ends] = END
    letters = np.take(np.array([A_LETTER, A_NUMBER, A_SPACE, A_BLANK, A_OTHER], np.uint8), kinds)
    blank = (kinds == SPACE) | (kinds == BLANK)
    letters[blank & ((then == SPACE) | (then == BLANK) | (then == END))] = A_MIDDLE
    marks = np.flatnonzero(codes == ord("'"))
    if len(marks):
        next1, next2 = np.zeros(len(codes), np.uint32), np.zeros(len(codes), np.uint32)
        next1[:-1] = codes[1:]
        next1[ends] = 0
        next2[:-1] = next1[1:]
        next2[ends] = 0
        first, second = next1[marks], next2[marks]
        letters[marks[np.isin(first, [ord(c) for c in "sdmt"])]] = A_ONE
        two = np.zeros(len(marks), bool)
        for a, b in ("ll", "ve", "re"):
            two |= (first == ord(a)) & (second == ord(b))
        letters[marks[two]] = A_TWO
    return letters


def byte_names() -> dict[str, int]:
    """The printable characters by which byte-level vocabularies name bytes: printable bytes name themselves, the others follow from U+0100 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class Merging:
    """The transducer of byte-pair merging inside a word, compiled where texts lead it.

    A prefix's last token and number of tokens follow from those of shorter prefixes: a token ends the prefix's encoding if merging leaves
    it and the last token before it apart, and just one does. So a state is the longest end of the prefix that a longer token may begin with, and
    for each place where such a token may begin the last token before and by how many tokens the prefix there differs. A step adds the
    difference of two prefixes' numbers; packed entries hold 256 times the next state and 128 plus this difference.
    """

    def __init__(self, vocab: dict[str, int], merges: Iterable[tuple[str, str]]):
        names = byte_names()
        self.ids = {bytes(names[c] for c in word): k for word, k in vocab.items() if all(c in names for c in word)}
        self.bytes = {k: word for word, k in self.ids.items()}
        self.ranks = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(merges)}
        if len({merged for _, merged in self.ranks.values()}) < len(self.ranks):
            raise ValueError("two merges make one token")
        if any(bytes([b]) not in self.ids for b in range(256)):
            raise ValueError("a byte has no token")
        self.open = {word[:k] for word in self.ids for k in range(len(word))}  # what a longer token begins with
        self.apart: dict[tuple[int, int], bool] = {}
        self.clear()

    def clear(self) -> None:
        self.table = np.zeros((1024, 256), np.int32)  # 0: not compiled; 128 is in each entry
        self.states: list[tuple[bytes, tuple, tuple]] = []
        self.number: dict[tuple, int] = {}
        self.intern((b"", (-1,), (0,)))

    @property
    def full(self) -> bool:
        return len(self.states) >= STATES

    def intern(self, state: tuple) -> int:
        found = self.number.get(state)
        if found is None:
            found = self.number[state] = len(self.states)
            self.states.append(state)
            if found >= len(self.table):
                grown = np.zeros((2 * len(self.table), 256), np.int32)
                grown[:found] = self.table
                self.table = grown
        return found

    def merged(self, word: bytes) -> list[int]:
        """The tokens of a short word, by the merges themselves."""
        tokens = [self.ids[word[k : k + 1]] for k in range(len(word))]
        while len(tokens) > 1:
            best = min(((*self.ranks[pair], k) for k, pair in enumerate(zip(tokens, tokens[1:], strict=False)) if pair in self.ranks), default=None)
            if best is None:
                break
            _, made, k = best
            tokens[k : k + 2] = [made]
        return tokens

    def stays(self, before: int, token: int) -> bool:
        """Whether merging leaves the token as it is behind the one before (-1: at the start of a word)."""
        found = self.apart.get((before, token))
        if found is None:
            if len(self.apart) >= PAIRS:
                self.apart.clear()
            wanted = [token] if before < 0 else [before, token]
            found = self.apart[before, token] = self.merged(b"".join(self.bytes[t] for t in wanted)) == wanted
        return found

    def step(self, state: tuple, byte: int) -> tuple[tuple, int]:
        """The next state and how many tokens more the prefix has."""
        held, last, count = state
        text = held + bytes([byte])
        for a in range(len(text)):
            token = self.ids.get(text[a:])
            if token is not None and self.stays(last[a], token):
                break
        more = count[a] + 1
        b = next(b for b in range(len(text) + 1) if text[b:] in self.open)
        needed = [text[k:] in self.open for k in range(b, len(text))]
        lasts = tuple(x if y else None for x, y in zip(last[b:], needed, strict=True))
        counts = tuple(x - more if y else 0 for x, y in zip(count[b:], needed, strict=True))
        return (text[b:], (*lasts, token), (*counts, 0)), more

    def compile(self, state: int, byte: int) -> int:
        after, more = self.step(self.states[state], byte)
        target = self.intern(after)
        entry = self.table[state, byte] = target << 8 | more + 128
        return int(entry)

    def walk(self, state: int | tuple, word: bytes) -> tuple[int | tuple, int]:
        """The state behind the word and the tokens it adds; states that aren't kept are tuples."""
        total = 0
        for byte in word:
            if not isinstance(state, tuple):
                entry = int(self.table[state, byte]) or (0 if self.full else self.compile(state, byte))
                if entry:
                    state, total = entry >> 8, total + (entry & 255) - 128
                    continue
                state = self.states[state]
            after, more = self.step(state, byte)
            state, total = self.number.get(after, after), total + more
        return state, total

    def run(self, text: np.ndarray, at: np.ndarray, length: np.ndarray, state: int | tuple) -> tuple[np.ndarray, int | tuple]:
        """The tokens of each word text[at : at + length], all words at once, byte by byte; the first goes on from `state`, and the last one's is returned."""
        counts, states = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        order = np.argsort(-length, kind="stable")
        ending: int | tuple = 0
        kept = np.ones(len(at), bool)  # words whose states are all kept so far
        loose: dict[int, tuple[int, int | tuple]] = {}
        if isinstance(state, tuple):
            loose[0], kept[0] = (0, state), False
        else:
            states[0] = state
        longest = np.searchsorted(-length[order], -np.arange(int(length.max(initial=0)) + 1), side="right")  # at k: how many words have k bytes or more
        k = 0
        while k + 1 < len(longest) and longest[k + 1] >= FEW:
            own = order[: longest[k + 1]]
            own = own[kept[own]]
            byte = text[at[own] + k]
            entry = self.table[states[own], byte]
            missing = np.flatnonzero(entry == 0)
            if len(missing):
                keys = states[own[missing]] << 8 | byte[missing]
                for key in np.unique(keys).tolist():
                    if not self.full:
                        self.compile(key >> 8, key & 255)
                entry = self.table[states[own], byte]
                lost = entry == 0
                for w in own[lost].tolist():
                    loose[w], kept[w] = (k, int(states[w])), False
                own, entry = own[~lost], entry[~lost]
            states[own] = entry >> 8
            counts[own] += (entry & 255) - 128
            k += 1
        for w in order[: longest[k + 1]].tolist() if k + 1 < len(longest) else []:
            if kept[w]:
                loose[w] = (k, int(states[w]))
        for w, (a, held) in loose.items():
            held, more = self.walk(held, text[at[w] + a : at[w] + length[w]].tobytes())
            counts[w] += more
            if w == len(at) - 1:
                ending = held
        if len(at) - 1 not in loose:
            ending = int(states[-1])
        return counts, ending


class Counter:
    """Counts the tokens of texts as the vocabulary's library gives them; keeps its transducers from text to text."""

    def __init__(self, path: str = TOKENIZER):
        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        model, words = said["model"], said["pre_tokenizer"] or {}
        plain = not said.get("normalizer") and words.get("type") == "ByteLevel" and words.get("use_regex", True) and not words.get("add_prefix_space")
        if not plain or model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
            raise ValueError(f"{path} is no plain byte-level vocabulary")
        added = said.get("added_tokens", [])
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError("added tokens that take in what surrounds them aren't handled")
        self.special = re.compile("|".join(re.escape(t["content"]) for t in sorted(added, key=lambda t: -len(t["content"])))) if added else None
        self.kinds = Kinds(Tokenizer.from_file(path).pre_tokenizer)
        self.merging = Merging(model["vocab"], [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]])
        self.state: tuple[int, int | tuple] = (FRESH, 0)

    def pieces(self, texts: list[str | None], counts: np.ndarray) -> Iterator[tuple[int, bool, str, str]]:
        """(text's number, whether it starts here, characters, the two behind): texts between special tokens, which count one each, in pieces of a slice."""
        for n, text in enumerate(texts):
            spans, a = [], 0
            for m in self.special.finditer(text or "") if self.special else ():
                counts[n] += 1
                spans.append((a, m.start()))
                a = m.end()
            for a, b in [*spans, (a, len(text or ""))]:
                for k in range(a, b, SLICE):
                    yield n, k == a, text[k : min(k + SLICE, b)], text[k + SLICE : min(k + SLICE + 2, b)]

    def feed(self, pieces: list[tuple[int, bool, str, str]], counts: np.ndarray) -> None:
        """Adds the pieces' tokens to counts. What goes on from the slice before comes first and goes on from its state."""
        if self.merging.full:
            held = self.state[1]
            whole = held if isinstance(held, tuple) else self.merging.states[held]
            self.merging.clear()
            self.state = (self.state[0], self.merging.intern(whole))
        seen = np.cumsum([len(p[2]) + len(p[3]) for p in pieces])
        codes = np.frombuffer("".join(p[2] + p[3] for p in pieces).encode("utf-32-le"), np.uint32)
        letters = letters_of(codes, self.kinds.of(codes), seen - 1)
        ahead = sum(len(p[3]) for p in pieces)  # only the last piece looks ahead
        codes, letters = codes[: len(codes) - ahead], letters[: len(letters) - ahead]
        first = np.append(0, seen[:-1])
        begins = first[[p[1] for p in pieces]]
        letters[begins] += LETTERS
        starts, end = cut(letters, self.state[0])
        goes_on = not pieces[0][1]
        at = np.flatnonzero(starts)
        if goes_on and not starts[0]:
            at = np.append(0, at)
        width = 1 + (codes > 0x7F).astype(np.int64) + (codes > 0x7FF) + (codes > 0xFFFF)
        place = np.append(0, np.cumsum(width))
        text = np.frombuffer("".join(p[2] for p in pieces).encode(), np.uint8)
        length = np.diff(np.append(place[at], len(text)))
        entry = self.state[1] if goes_on and not starts[0] else 0
        tokens, behind = self.merging.run(text, place[at], length, entry)
        owner = np.array([p[0] for p in pieces])[np.searchsorted(first, at, side="right") - 1]
        np.add.at(counts, owner, tokens)
        self.state = (end, behind)

    def count(self, texts: list[str | None]) -> np.ndarray:
        counts, held, size = np.zeros(len(texts), np.int64), [], 0
        for piece in self.pieces(texts, counts):
            held.append(piece)
            size += len(piece[2])
            if size >= SLICE or piece[3]:
                self.feed(held, counts)
                held, size = [], 0
        if held:
            self.feed(held, counts)
        return counts


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """The worker's transducers, compiled once for all its tasks."""
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, tokenizer: str = TOKENIZER, limit: int = LIMIT) -> tuple[DataFrame, dict[str, str]]:
    """docs with n_bytes, n_tokens and over_limit; the second value maps these to the names they got.

    The number of tokens is that of the vocabulary's library without added tokens; special tokens' strings inside a text are one token
    each, as is its default. Texts are read whole, in slices whose state goes on, however long they are; null texts are empty ones and have
    none. Rows are counted each by itself, so repeated rows and null ids don't matter; an empty table gives an empty one;
    columns of docs with our names are kept, ours then start with "_". Nothing is shuffled.
    """
    n_bytes, n_tokens, over = unused(docs, "n_bytes", "n_tokens", "over_limit")
    schema = StructType([*docs.schema.fields, StructField(n_tokens, LongType(), False)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(tokenizer)
        for batch in batches:
            found = own.count(batch["text"].to_pylist())
            yield pa.record_batch([*batch.columns, pa.array(found, pa.int64())], [*batch.schema.names, n_tokens])

    counted = docs.mapInArrow(work, schema)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return counted.withColumns({n_bytes: size, over: F.col(n_tokens) > limit}), {"n_bytes": n_bytes, "n_tokens": n_tokens, "over_limit": over}


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document, and whether they are more than a context of 1,024."""
    counted, n = count_tokens(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return counted.select("doc_id", n["n_bytes"], n["n_tokens"], n["over_limit"])
