"""Language identification, words first: log frequencies of known words, shorter and shorter character n-grams for the others."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import REMEMBERED, fold, load, staged

#: Rows for each language that the classifier is fitted on (expected; a hash of the id draws them), and how many of its most
#: frequent words and n-grams it keeps of each language's sample.
TRAIN_ROWS = 2_000
WORDS, GRAMS = 50_000, 30_000
LONGEST = 4
UNDETERMINED = "und"
LETTER = regex.compile(r"\p{L}")
#: ASCII bytes that aren't letters part words; bytes of other characters stay.
PARTS = bytes(c if c >= 0x80 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))
JAVA_PARTS = r"[\x00-\x60\x7B-\x7F]+"


def letters(text: str) -> list[bytes]:
    return text.lower().encode().translate(PARTS).split()


def word_counts(rows: DataFrame) -> DataFrame:
    """(lang, word, n) over rows(lang, text)."""
    word = F.explode(F.split(F.lower("text"), JAVA_PARTS)).alias("word")
    return rows.select("lang", word).filter("word <> ''").groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))


def gram_counts(counts: DataFrame) -> DataFrame:
    """(lang, size, gram, n) over the words, a space at either end; each word counts once."""
    framed = F.concat(F.lit(" "), F.col("word"), F.lit(" "))
    grams = [F.transform(F.sequence(F.lit(1), F.greatest(F.length(framed) - (k - 1), F.lit(1))), lambda i, k=k: F.substring(framed, i, F.lit(k))) for k in range(1, LONGEST + 1)]
    spread = counts.repartition(counts.sparkSession.sparkContext.defaultParallelism)  # the words fit one file, but not one core
    return spread.select("lang", F.explode(F.concat(*grams)).alias("gram")).groupBy("lang", "gram").agg(F.count(F.lit(1)).alias("n"))


def most_frequent(counts: DataFrame, key: str, langs: list[str], most: int) -> tuple[list[str], np.ndarray]:
    """The `most` keys with the highest counts of each language, in order, and their counts in every language; ties go by the key."""
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), key))
    kept = counts.withColumn("rank", rank).filter(F.col("rank") <= most).select(key).distinct()
    by = [F.sum(F.when(F.col("lang") == k, F.col("n")).otherwise(0)).alias(f"n{i}") for i, k in enumerate(langs)]
    found = counts.join(kept, key, "left_semi").groupBy(key).agg(*by).toArrow().sort_by(key)
    return found[key].to_pylist(), np.stack([found[f"n{i}"].to_numpy() for i in range(len(langs))], axis=1).astype(np.float64)


def fit(docs: DataFrame, learn: Column, train_rows: int = TRAIN_ROWS) -> dict:
    """The model, from the rows of docs(doc_id, text, lang) where learn holds and neither text nor lang is null.

    A classifier may be fitted on a bounded sample: for each language a hash of the id draws `train_rows` rows, or takes all.
    Repeated rows count each; without any row the model knows no language; other columns of docs don't matter.
    """
    rows = docs.filter(learn & F.col("text").isNotNull() & F.col("lang").isNotNull())
    found = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(found)
    if not langs:
        return {"langs": [], "table": {}, "scores": np.zeros((0, 0), np.float32)}
    rate = F.coalesce(*[F.when(F.col("lang") == k, F.lit(train_rows / n)) for k, n in found.items()])
    drawn = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("language")), F.lit(1 << 30)) < rate * float(1 << 30)
    counts = staged(word_counts(rows.filter(drawn).select("lang", "text")), "language-words")
    table, parts = {}, []
    for key, mark, (keys, seen) in (("word", b"", most_frequent(counts, "word", langs, WORDS)), ("gram", b"\0", most_frequent(gram_counts(counts), "gram", langs, GRAMS))):
        # an n-gram's key starts with a byte that no word has; n-grams of each length have frequencies of their own
        size = np.array([len(x) if key == "gram" else 0 for x in keys], np.int64)
        part = np.zeros(seen.shape, np.float32)
        for k in set(size.tolist()):
            own = seen[size == k]
            part[size == k] = np.log((own + 0.5) / (own.sum(axis=0) + 0.5 * (len(own) + 1)))
        start = len(table)
        table.update({mark + x.encode(): start + i for i, x in enumerate(keys)})
        parts.append(part)
    return {"langs": langs, "table": table, "scores": np.concatenate(parts)}


class Memo(dict):
    """Words to rows of scores; works out rows for words that the model doesn't have."""

    def __init__(self, owner: Predictor):
        super().__init__(owner.table)
        self.owner = owner

    def __missing__(self, word: bytes) -> int:
        row = self.owner.unseen(word)
        if len(word) <= REMEMBERED:
            self[word] = row
        return row


class Predictor:
    """Scores texts by a model; remembers what it worked out for words that the model doesn't have."""

    MEMO = 100_000

    def __init__(self, model: dict):
        self.langs, self.table, self.scores = model["langs"], model["table"], model["scores"]
        self.clear()

    def clear(self) -> None:
        self.memo = Memo(self)
        self.rows = np.vstack([self.scores, np.zeros((1024, len(self.langs)), np.float32)]) if self.langs else None
        self.used = len(self.scores)
        self.waiting, self.known = [], []

    def unseen(self, word: bytes) -> int:
        """The number of the word's row, which settle() fills with the mean row of its longest known n-grams."""
        get, framed = self.table.get, b" " + word + b" "
        text = None if word.isascii() else framed.decode("utf-8", "replace")  # n-grams are of characters
        for k in range(LONGEST, 0, -1) if word else ():
            if text is None:
                known = [g for i in range(len(framed) - k + 1) if (g := get(b"\0" + framed[i : i + k])) is not None]
            else:
                known = [g for i in range(len(text) - k + 1) if (g := get(b"\0" + text[i : i + k].encode())) is not None]
            if known:
                self.waiting.append((self.used, len(known)))
                self.known += known
                break
        self.used += 1
        if len(self.known) > self.MEMO:
            self.settle()
        return self.used - 1

    def settle(self) -> None:
        """Fills the rows of words that came since the last time, all at once; words without known n-grams have zeros."""
        while self.used > len(self.rows):
            self.rows = np.vstack([self.rows, np.zeros_like(self.rows)])
        if self.waiting:
            at, sizes = np.array(self.waiting).T
            self.rows[at] = np.add.reduceat(self.scores[self.known], np.cumsum(sizes) - sizes, axis=0) / sizes[:, None].astype(np.float32)
        self.waiting, self.known = [], []

    def of(self, words: list[bytes]) -> np.ndarray:
        """The words' rows of scores by language."""
        if self.used > len(self.scores) + self.MEMO:
            self.clear()
        at = list(map(self.memo.__getitem__, words))
        self.settle()
        return self.rows[at]

    def __call__(self, text: str | None) -> tuple[str, float]:
        if text is None or not self.langs or not LETTER.search(text):
            return UNDETERMINED, 0.0
        words = letters(text)
        total = sum(self.of(words[k : k + self.MEMO]).sum(axis=0, dtype=np.float64) for k in range(0, max(1, len(words)), self.MEMO))
        best = int(total.argmax())  # a tie goes to the first language
        return self.langs[best], float(1 / np.exp(total - total[best]).sum())


def identify(docs: DataFrame, model: dict) -> DataFrame:
    """docs(doc_id, text) -> doc_id, lang_pred, score: the most likely language and its posterior probability.

    `und` with score 0 where the text is null or has no letter (Unicode category L), or where nothing was learned. Whole
    texts count, however long; a tie goes to the first language in the order of names; repeated rows are judged alike; null ids
    stay; an empty table gives an empty one; other columns of docs, whatever their names, are left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = Predictor(shared.value)
        for batch in batches:
            found = [predictor(x.as_py()) for x in batch["text"]]
            yield pa.record_batch([batch["doc_id"], pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(predict, "doc_id long, lang_pred string, score double")


def keep_known(docs: DataFrame, model: dict) -> DataFrame:
    """The rows of docs, with all columns, whose language is determined.

    What goes are rows whose text is null or has no letter, and all rows where nothing was learned; a text that is hard to
    tell stays. Repeated rows are judged alike, null ids and clashing columns stay as they are, an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = Predictor(shared.value)
        for batch in batches:
            yield batch.filter(pa.array([predictor(x.as_py())[0] != UNDETERMINED for x in batch["text"]], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document; the fold crc32(doc_id) mod 4 = 2 is held out."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = fold(F.col("doc_id"), 4) == 2
    found = identify(docs, fit(docs, ~held))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")
