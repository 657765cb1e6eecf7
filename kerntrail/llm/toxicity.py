"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy, with thresholds by language."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language
from .common import REMEMBERED, fold, load, staged

#: Labelled rows that the classifier is fitted on, for each label (expected; a hash of the id draws them).
TRAIN_ROWS = {1: 2_500, 0: 5_000}
#: Bytes of their texts, for each label: fewer rows are drawn where texts are long (expected).
TRAIN_BYTES = {1: 24 << 20, 0: 48 << 20}
BUCKETS, DIM, FILTERS, WIDTHS = 1 << 17, 12, 12, (1, 2, 3)
PARTS = (3, 4, 5)
#: Where the second checksum of a word starts, and the checksums of single bytes.
SECOND = 0x5BD1E995
CRC = np.array([zlib.crc32(bytes([k]), 0xFFFFFFFF) ^ 0xFFFFFFFF for k in range(256)], np.uint32)
EPOCHS, BATCH, RATE, ACC = 6, 32, 0.08, 1e-3
CHUNK = 60_000
#: Bins of a logit's unit in which labelled rows are counted for thresholds; logits beyond LOGITS count as that.
BINS, LOGITS = 256, 64
#: Labelled rows of a language's rarer label at which its threshold stands midway between its own best one and the common one.
MIDWAY = 10


class Numbers(dict):
    """Numbers words as they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def ids_of(texts: list[str | None], seen: Numbers) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all words in a row, and where each text starts; a text gets pads in front and behind, seen is filled."""
    pad, out, starts = [seen[b""]] * (max(WIDTHS) - 1), [], []
    for text in texts:
        starts.append(len(out))
        out += pad
        out.extend(map(seen.__getitem__, language.letters(text or "")))
        out += pad
    return np.array(out, np.int64), np.array(starts, np.int64)


def crcs(letters: np.ndarray, starts: np.ndarray, sizes: np.ndarray, seed: int = 0) -> np.ndarray:
    """zlib.crc32 of many pieces of letters, longest first: a byte of every piece at a time."""
    state = np.full(len(starts), seed ^ 0xFFFFFFFF, np.uint32)
    for k in range(sizes[0] if len(sizes) else 0):
        own = state[: np.searchsorted(-sizes, -k)]  # of pieces longer than k
        own[:] = CRC[(own ^ letters[starts[: len(own)] + k]) & 0xFF] ^ (own >> 8)
    return ~state


def buckets(words: list[bytes]) -> np.ndarray:
    """The buckets of each word: two of the word itself and one of each beginning of PARTS bytes; its embedding is their sum.

    The pad has none: bucket 0 stays zero.
    """
    crc, sizes = zlib.crc32, np.fromiter(map(len, words), np.int64, len(words))
    out, order = np.zeros((len(words), 2 + len(PARTS)), np.int64), np.argsort(-sizes, kind="stable")
    sizes, starts = sizes[order], (np.cumsum(sizes) - sizes)[order]
    # a few long words aren't worth a step for each of their bytes
    n = np.searchsorted(-sizes, -REMEMBERED)
    for i in order[:n]:
        out[i] = [crc(words[i]), crc(words[i], SECOND), *(crc(words[i][:k], k) for k in PARTS)]
    letters, order, sizes, starts = np.frombuffer(b"".join(words), np.uint8), order[n:], sizes[n:], starts[n:]
    out[order, 0], out[order, 1] = crcs(letters, starts, sizes), crcs(letters, starts, sizes, SECOND)
    for i, k in enumerate(PARTS):
        n = np.searchsorted(-sizes, -k)  # words longer than k
        out[order[:n], 2 + i] = crcs(letters, starts[:n], np.full(n, k), k)
    out[order[np.searchsorted(-sizes, 0) :]] = 0
    return np.where(out, out % (BUCKETS - 1) + 1, 0)


class Network:
    """Embeddings -> filters of each width -> maximum over the text -> logistic output."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.e = rng.normal(0, 0.02, (BUCKETS, DIM)).astype(np.float32)
        self.e[0] = 0
        self.w = [rng.normal(0, 0.4, (k, DIM, FILTERS)).astype(np.float32) for k in WIDTHS]
        self.b = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.v = rng.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32)
        self.c = np.zeros(1, np.float32)

    def filtered(self, x: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
        """For each width the filters' values at each position but the last width - 1; x: embeddings of words, at: words."""
        for w, b in zip(self.w, self.b, strict=True):
            n = len(at) - len(w) + 1
            z = (x @ w[0])[at[:n]]
            for k in range(1, len(w)):
                z += (x @ w[k])[at[k : k + n]]
            yield z + b

    def logits(self, words: list[bytes], at: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Of texts as ids_of numbers their words."""
        x = self.e[buckets(words)].sum(axis=1)
        edge = np.append(starts[1:], len(at))
        pooled = []
        for w, z in zip(WIDTHS, self.filtered(x, at), strict=True):
            # windows that reach into the next text are of pads and its first words: they are left out
            cut = np.stack([starts, np.minimum(edge - w + 1, len(z))], axis=1).ravel()
            cut = cut[:-1] if cut[-1] == len(z) else cut
            pooled.append(np.maximum.reduceat(z, cut, axis=0)[::2])
        return np.maximum(np.hstack(pooled), 0) @ self.v + self.c

    def gradients(self, x: np.ndarray, at: np.ndarray, sizes: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> tuple:
        """Of the weighted mean of texts' logistic losses, by embeddings x, filters, their biases, the output's weights and its bias.

        at: the words of texts one after the other; sizes: how many each has. Only the positions of maxima get gradients.
        """
        starts = np.cumsum(sizes) - sizes
        pooled, where = [], []
        for w, z in zip(WIDTHS, self.filtered(x, at), strict=True):
            best = np.stack([s + z[s : s + n - w + 1].argmax(axis=0) for s, n in zip(starts, sizes, strict=True)])
            where.append(best)
            pooled.append(np.take_along_axis(z, best, 0))
        hidden = np.maximum(np.hstack(pooled), 0)
        p = 1 / (1 + np.exp(-(hidden @ self.v + self.c)))
        d = (p - labels) * weight / len(labels)
        back = d[:, None] * self.v * (hidden > 0)
        dx, dw, db = np.zeros_like(x), [], []
        for i, best in enumerate(where):
            g = back[:, i * FILTERS : (i + 1) * FILTERS]
            own_dw = np.zeros_like(self.w[i])
            for o in range(WIDTHS[i]):
                own = at[best + o]  # texts x filters
                own_dw[o] = np.einsum("tf,tfd->df", g, x[own])
                np.add.at(dx, own.ravel(), (g[:, :, None] * self.w[i][o].T[None]).reshape(-1, DIM))
            dw.append(own_dw)
            db.append(g.sum(axis=0))
        return dx, dw, db, hidden.T @ d, d.sum(keepdims=True)

    def train(self, texts: list[str], labels: np.ndarray, seed: int = 11) -> None:
        """Adagrad on the logistic loss, both labels weighing the same."""
        rng, seen = np.random.default_rng(seed), Numbers()
        docs = [ids_of([t], seen)[0] for t in texts]
        table = buckets(list(seen))
        weight = np.where(labels == 1, 0.5 / max(labels.mean(), 1e-9), 0.5 / max(1 - labels.mean(), 1e-9)).astype(np.float32)
        params = [self.e, *self.w, *self.b, self.v, self.c]
        fresh = self.e.copy()
        gains = [np.full(p.shape, ACC, np.float32) for p in params]

        def step(k: int, grad: np.ndarray, rows=slice(None)) -> None:
            gains[k][rows] += grad * grad
            params[k][rows] -= RATE * grad / np.sqrt(gains[k][rows])

        for _ in range(EPOCHS):
            order = rng.permutation(len(docs))
            for k in range(0, len(order), BATCH):
                batch = order[k : k + BATCH]
                words, at = np.unique(np.concatenate([docs[i] for i in batch]), return_inverse=True)
                x = self.e[table[words]].sum(axis=1)
                sizes = np.array([len(docs[i]) for i in batch])
                dx, dw, db, dv, dc = self.gradients(x, at, sizes, labels[batch], weight[batch])
                for i in range(len(WIDTHS)):
                    step(1 + i, dw[i])
                    step(1 + len(WIDTHS) + i, db[i])
                step(len(params) - 2, dv)
                step(len(params) - 1, dc)
                used = np.flatnonzero(np.abs(dx).any(axis=1))
                rows, inverse = np.unique(table[words[used]].ravel(), return_inverse=True)
                grad = np.zeros((len(rows), DIM), np.float32)
                np.add.at(grad, inverse, np.repeat(dx[used], table.shape[1], axis=0))
                grad[rows == 0] = 0
                step(0, grad, rows)
        self.e[(self.e == fresh).all(axis=1)] = 0  # words that no gradient reached say nothing


def logits_and_languages(net: Network, predictor: language.Predictor, texts: list[str | None]) -> tuple[np.ndarray, list[str]]:
    """Both from one division into words; a text without words or, with no language learned, any is undetermined."""
    seen = Numbers()
    at, starts = ids_of(texts, seen)
    words = list(seen)
    if not predictor.langs:
        return net.logits(words, at, starts), [language.UNDETERMINED] * len(texts)
    total = np.add.reduceat(predictor.of(words)[at], starts, axis=0, dtype=np.float64)
    bare = np.diff(np.append(starts, len(at))) == 2 * (max(WIDTHS) - 1)
    return net.logits(words, at, starts), [language.UNDETERMINED if b else predictor.langs[k] for b, k in zip(bare, total.argmax(axis=1), strict=True)]


def best_threshold(bins: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> float:
    """The middle of the gap between bins of logits with the fewest errors (the widest such gap).

    bins: their numbers, rising; toxic, clean: what rows of either label count in each.
    """
    below, above = np.append(bins[0] - BINS, bins + 1), np.append(bins, bins[-1] + 1 + BINS)
    errors = np.append(0, np.cumsum(toxic)) + np.sum(clean) - np.append(0, np.cumsum(clean))
    k = np.lexsort((below - above, np.round(errors, 6)))[0]
    return float(below[k] + above[k]) / 2 / BINS


def train(docs: DataFrame, labels: DataFrame, learn: Column, train_rows: dict[int, int] | None = None) -> tuple[dict, DataFrame]:
    """The model without thresholds, and (labelled, toxic, trained): the labelled ids of the fold, and whether it was trained on each.

    The network may be fitted on a bounded sample: for each label a hash of the id draws TRAIN_ROWS rows of TRAIN_BYTES together
    at most, or all, and a fifth of them is spared, so that some are left for thresholds where all are drawn. Of labels that
    differ for one id the greater counts; null texts and null labels teach nothing.
    """
    train_rows = train_rows or TRAIN_ROWS
    known = labels.filter(learn & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    found = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    sizes = docs.select("doc_id", F.octet_length("text").alias("size")).join(known, "doc_id").groupBy("toxic").agg(F.sum("size").alias("size"))
    sizes = {r["toxic"]: r["size"] or 0 for r in sizes.collect()}
    share = {k: min(1.0, train_rows[k] / found[k], TRAIN_BYTES[k] / max(sizes.get(k, 0), 1)) for k in (0, 1) if found.get(k)}
    rate = F.coalesce(*[F.when(F.col("toxic") == k, F.lit(v)) for k, v in share.items()], F.lit(0.0))
    drawn = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("toxicity")), F.lit(1 << 30)) < rate * float(1 << 30)
    trained = drawn & (F.pmod(F.xxhash64(F.lit("calibrate"), F.col("doc_id")), F.lit(5)) != 0)
    known = known.select(F.col("doc_id").alias("labelled"), "toxic", trained.alias("trained"))
    if not found.get(0) or not found.get(1):
        return {"constant": 1.0 if found.get(1) else 0.0}, known
    # ids are drawn before texts are met: as many as train_rows says go to every task, and no text is shuffled
    chosen = F.broadcast(known.filter("trained"))
    sample = docs.filter(F.col("text").isNotNull()).join(chosen, F.col("doc_id") == F.col("labelled")).select("text", "toxic", "doc_id").toArrow()
    if len(set(sample["toxic"].to_pylist())) < 2:
        return {"constant": 1.0 if 1 in sample["toxic"].to_pylist() else 0.0}, known
    order = np.argsort(sample["doc_id"].to_numpy(), kind="stable")  # in whatever order the rows came
    net = Network()
    net.train([sample["text"][int(i)].as_py() for i in order], sample["toxic"].to_numpy()[order].astype(np.float32))
    spared = {k: 1 - 0.8 * share[k] for k in (0, 1)}
    return {"net": net, "langs": language.fit(docs, learn), "clean": spared[1] / spared[0]}, known


def calibrated(model: dict, found: DataFrame, known: DataFrame) -> dict:
    """The model with thresholds by language, from logits(...) of all labelled rows that the network wasn't trained on.

    Rows are counted by language, bin and label in Spark, so that no row is left out; a clean row counts `clean` times, since
    training takes other shares of the labels. A language's threshold is drawn towards the common one, the more the fewer rows of its
    rarer label there are: wholly without any, halfway with MIDWAY. Where one label has no row that is left, all rows count.
    """
    if "constant" in model:
        return model
    place = F.floor(F.greatest(F.least(F.col("z"), F.lit(float(LOGITS))), F.lit(-float(LOGITS))) * BINS).alias("bin")
    rows = found.filter("given").select("doc_id", "lang", place).join(known, F.col("doc_id") == F.col("labelled"))
    rows = rows.groupBy("lang", "bin", "toxic", "trained").agg(F.count(F.lit(1)).alias("n")).toPandas()
    left, clean = rows[~rows["trained"].astype(bool)], model["clean"]
    if set(left["toxic"]) != {0, 1}:
        left, clean = rows, 1.0

    def counts(some) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        bins, at = np.unique(some["bin"].to_numpy(np.int64), return_inverse=True)
        return bins, *[np.bincount(at, some["n"].to_numpy() * (some["toxic"].to_numpy() == k), len(bins)) for k in (1, 0)]

    def level(bins: np.ndarray, toxic: np.ndarray, others: np.ndarray) -> float:
        return best_threshold(bins, toxic, clean * others)

    own = {lang: counts(some) for lang, some in left.groupby("lang")}
    common, thresholds = level(*counts(left)), {}
    for lang, x in own.items():
        rarer = min(x[1].sum(), x[2].sum())
        if rarer:
            thresholds[lang] = float(common + (level(*x) - common) * rarer / (rarer + MIDWAY))
    return model | {"common": common, "thresholds": thresholds}


def fit(docs: DataFrame, labels: DataFrame, learn: Column, train_rows: dict[int, int] | None = None) -> dict:
    """The model, from docs(doc_id, text, lang) whose label is known and for which learn holds."""
    model, known = train(docs, labels, learn, train_rows)
    return model if "constant" in model else calibrated(model, logits(docs.filter(learn), model), known)


def chunks(texts: pa.Array) -> Iterator[list[str | None]]:
    """The texts in lists of about CHUNK words."""
    held, size = [], 0
    for text in texts:
        held.append(text.as_py())
        size += len(held[-1] or "") // 5
        if size >= CHUNK:
            yield held
            held, size = [], 0
    if held:
        yield held


def logits(docs: DataFrame, model: dict) -> DataFrame:
    """docs(doc_id, text) -> doc_id, z (logit), lang (that the text shows), given (whether there is a text)."""
    shared = docs.sparkSession.sparkContext.broadcast({k: model[k] for k in ("net", "langs")})

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        predictor = language.Predictor(own["langs"])
        for batch in batches:
            z, langs = [np.zeros(0)], []
            for texts in chunks(batch["text"]):
                some, seen = logits_and_languages(own["net"], predictor, texts)
                z.append(some.astype(float))
                langs += seen
            yield pa.record_batch([batch["doc_id"], pa.array(np.concatenate(z)), pa.array(langs, pa.string()), batch["text"].is_valid()], ["doc_id", "z", "lang", "given"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, "doc_id long, z double, lang string, given boolean")


def levelled(found: DataFrame, model: dict) -> DataFrame:
    """logits(...) -> doc_id, score."""
    level = F.lit(model["common"])
    if model["thresholds"]:
        level = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in model["thresholds"].items() for x in pair]), F.col("lang")), level)
    above = F.greatest(F.least(F.col("z") - level, F.lit(40.0)), F.lit(-40.0))
    return found.select("doc_id", (1 / (1 + F.exp(-above))).alias("score"))


def score(docs: DataFrame, model: dict) -> DataFrame:
    """docs(doc_id, text) -> doc_id, score: 0.5 where the logit meets the threshold of the text's language.

    Whole texts count, null ones as empty; the score of a text without words is that of pads alone. Without labels of both
    kinds all scores are 1 or 0, whichever label was seen (0: none). Repeated rows score alike; null ids stay; an empty table
    gives an empty one; other columns of docs, whatever their names, are left out.
    """
    if "constant" in model:
        return docs.select(F.col("doc_id").cast("long"), F.lit(model["constant"]).alias("score"))
    return levelled(logits(docs, model), model)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document; labels are learned from ids with crc32 mod 5 above 0."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = fold(F.col("doc_id"), 5) == 0
    model, known = train(docs, load(spark, sf_dir, "labels"), ~held)
    if "constant" in model:
        scored = score(docs, model)
    else:  # texts are read once for thresholds and scores
        found = staged(logits(docs, model), "logits")
        scored = levelled(found, calibrated(model, found, known))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
