"""The classifier's gradients against differences, its buckets against a loop, thresholds of languages with few labels, and memos of long words."""

import random
import time
import zlib

import numpy as np
import pandas as pd
import pytest

from kerntrail.llm import language, packing, scoring, toxicity
from kerntrail.llm.common import REMEMBERED


def test_gradients_equal_differences():
    rng = np.random.default_rng(3)
    net = toxicity.Network()
    net.e = net.w = net.b = None  # float64 below
    x = rng.normal(size=(9, toxicity.DIM))
    net.w = [rng.normal(0, 0.4, (k, toxicity.DIM, toxicity.FILTERS)) for k in toxicity.WIDTHS]
    net.b = [rng.normal(0, 0.1, toxicity.FILTERS) for _ in toxicity.WIDTHS]
    net.v, net.c = rng.normal(size=toxicity.FILTERS * len(toxicity.WIDTHS)), np.array([0.2])
    sizes = np.array([5, 7, 4])
    at = rng.integers(0, 9, sizes.sum())
    labels, weight = np.array([1.0, 0.0, 1.0]), np.array([0.7, 1.3, 0.4])

    def loss():
        starts, total = np.cumsum(sizes) - sizes, 0.0
        z = list(net.filtered(x, at))
        for i, (s, n) in enumerate(zip(starts, sizes, strict=True)):
            hidden = np.concatenate([np.maximum(v[s : s + n - w + 1].max(axis=0), 0) for w, v in zip(toxicity.WIDTHS, z, strict=True)])
            logit = hidden @ net.v + net.c[0]
            total += weight[i] * (np.log1p(np.exp(-logit)) if labels[i] else np.log1p(np.exp(logit)))
        return total / len(sizes)

    dx, dw, db, dv, dc = net.gradients(x, at, sizes, labels, weight)
    for values, grad in [(x, dx), *zip(net.w, dw, strict=True), *zip(net.b, db, strict=True), (net.v, dv), (net.c, dc)]:
        flat, own = values.reshape(-1), np.asarray(grad).reshape(-1)
        for k in rng.choice(len(flat), min(40, len(flat)), replace=False):
            was, h = flat[k], 1e-6
            flat[k] = was + h
            up = loss()
            flat[k] = was - h
            down = loss()
            flat[k] = was
            assert own[k] == pytest.approx((up - down) / (2 * h), abs=1e-7, rel=1e-4)


def test_thresholds_are_drawn_towards_the_common_one(spark):
    """The more the fewer labels a language has: none, one, many."""
    rows = []
    for lang, toxic_at, n in (("many", 2.0, 400), ("few", 2.0, 1), ("none", 2.0, 0), ("rest", -2.0, 2000)):
        rows += [(lang, toxic_at, 1)] * n + [(lang, toxic_at - 1.0, 0)] * max(n, 3)
    frame = pd.DataFrame(rows, columns=["lang", "z", "toxic"]).assign(doc_id=range(len(rows)))
    found = spark.createDataFrame(frame[["doc_id", "z", "lang"]]).selectExpr("doc_id", "z", "lang", "true AS given")
    known = spark.createDataFrame(frame[["doc_id", "toxic"]].assign(trained=False)).withColumnRenamed("doc_id", "labelled")
    model = toxicity.calibrated({"clean": 1.0}, found, known)
    own, common = model["thresholds"], model["common"]
    assert "none" not in own and abs(own["many"] - 1.5) < 0.1 < abs(common - 1.5)
    assert min(common, own["many"]) < own["few"] < max(common, own["many"]) and abs(own["few"] - common) < 0.2 * abs(own["many"] - common)


def test_memos_leave_long_words_out():
    long, short = b"x" * (REMEMBERED + 1), b"short"
    hashes = scoring.Hashes()
    assert hashes[long] == scoring.xxhash.xxh3_64_intdigest(long) and hashes[short] and list(hashes) == [short]
    encoder = packing.Encoder()
    text = " " + "y" * 5000 + " short"
    assert encoder.decode(np.frombuffer(encoder.encode(text), "<u2")) == text and list(encoder) == [" short"]
    model = {"langs": ["a", "b"], "table": {b"\0x": 0, b"\0s": 1}, "scores": np.array([[0.0, -1.0], [-2.0, 0.0]], np.float32)}
    predictor = language.Predictor(model)
    assert predictor(long.decode())[0] == "a" and predictor("short")[0] == "b" and short in predictor.memo and long not in predictor.memo


def test_a_text_of_more_words_than_the_memo(monkeypatch):
    model = {"langs": ["a", "b"], "table": {b"x": 0, b"y": 1}, "scores": np.array([[0.0, -1.0], [-2.0, 0.0]], np.float32)}
    whole = language.Predictor(model)("x x y new " * 50)
    monkeypatch.setattr(language.Predictor, "MEMO", 7)
    assert language.Predictor(model)("x x y new " * 50) == pytest.approx(whole)


def plain_buckets(words):
    crc = zlib.crc32
    rows = [[crc(w), crc(w, 0x5BD1E995), *(crc(w[:k], k) if len(w) > k else 0 for k in toxicity.PARTS)] if w else [0] * 5 for w in words]
    return [[x % (toxicity.BUCKETS - 1) + 1 if x else 0 for x in row] for row in rows]


def test_buckets_of_many_words_equal_a_loop_and_take_less_time():
    rng = random.Random(5)
    awkward = [b"", *(rng.randbytes(k) for k in (1, 2, 3, 4, 5, 6, REMEMBERED, REMEMBERED + 1, 5000)), b"", "é".encode(), b"\0" * 9]
    for words in ([], [b""], awkward[-3:], awkward, awkward[::-1]):
        assert toxicity.buckets(words).shape == (len(words), 5) and toxicity.buckets(words).tolist() == plain_buckets(words)
    words = ["".join(rng.choices("abcdeést", k=rng.randint(1, 14))).encode() for _ in range(20_000)]

    def spent(f):
        began = time.process_time()
        return f(words), time.process_time() - began

    ours, loop = [spent(toxicity.buckets) for _ in range(3)], [spent(plain_buckets) for _ in range(3)]
    assert ours[0][0].tolist() == loop[0][0] and min(x[1] for x in ours) < 0.5 * min(x[1] for x in loop)


@pytest.mark.parametrize("memo", [5, 100_000])
def test_rows_of_unknown_words_are_means_of_their_longest_known_grams(monkeypatch, memo):
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcéß𝄞", k=rng.randint(1, 9)))
    grams = sorted({f" {word()} "[rng.randint(0, 3) :][: rng.randint(1, 4)] for _ in range(300)} - {"a", "c", "ß", ""})
    scores = np.random.default_rng(6).normal(size=(len(grams), 3)).astype(np.float32)
    monkeypatch.setattr(language.Predictor, "MEMO", memo)
    predictor = language.Predictor({"langs": ["x", "y", "z"], "table": {b"\0" + g.encode(): i for i, g in enumerate(grams)}, "scores": scores})
    for _ in range(3):
        words = [word() for _ in range(700)] + ["", "a" * 300]
        for w, row in zip(words, predictor.of([w.encode() for w in words]), strict=True):
            parts = ([p for i in range(len(w) + 3 - k) if (p := f" {w} "[i : i + k]) in grams] for k in (4, 3, 2, 1))
            known = next(filter(None, parts), None) if w else None
            assert np.allclose(row, scores[[grams.index(p) for p in known]].mean(axis=0) if known else 0, atol=1e-5), w
