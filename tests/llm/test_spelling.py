"""Spelling variants against plain loops."""

import random
import re
import zlib
from collections import Counter

import pytest

from kerntrail.llm import spelling
from kerntrail.llm.spelling import near_words, variants


def one_edit(u, v):
    if len(u) > len(v):
        u, v = v, u
    if len(v) - len(u) > 1 or u == v:
        return False
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v, strict=True)) == 1
    return any(v[:i] + v[i + 1 :] == u for i in range(len(v)))


def expected(rows, least=7, times=10, every=31):
    counts = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % every == 0:
                i = h % len(run)
                run = run[:i] + run[i + 1 :]
            if len(run) >= least:
                counts[run] += 1
    words = {w: n for w, n in counts.items() if n >= 2}
    near = {w: [v for v in words if abs(len(v) - len(w)) < 2 and one_edit(w, v)] for w in words}
    best = {w: min(near[w], key=lambda v: (-words[v], v)) for w in words if near[w]}
    forms = {w: v for w, v in best.items() if words[v] >= times * words[w]}
    out = set()
    for w, n in words.items():
        root = w
        while root in forms:
            root = forms[root]
        out.add((w, forms.get(w), root, n, len(near[w]), words[forms[w]] if w in forms else None))
    return out


def found(df):
    return {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def test_equals_loops_over_all_pairs(spark, edge_rows, edge_docs):
    got = variants(edge_docs, least=4)
    rows = found(got)
    assert rows == expected(edge_rows, least=4) and rows
    assert got.count() == len(rows)


@pytest.fixture(scope="module")
def crowded():
    """Words of a small alphabet with one beginning, so that every key is crowded; chains of forms; ties; a very long word."""
    rng = random.Random(3)
    words = {"prefix" + "".join(rng.choice("ab") for _ in range(rng.randint(2, 8))) for _ in range(250)}
    texts = [(k, " ".join([w] * rng.choice([1, 2, 2, 3, 30])), "x") for k, w in enumerate(sorted(words))]
    chain = ["chained" + "x" * k for k in range(4)]
    texts += [(1000 + k, " ".join([w.title()] * 2 * 10**k), "x") for k, w in enumerate(chain)]
    texts += [(2000, " ".join([w] * 2 for w in ()) + " ".join(["y" * 150_000] * 2 + ["y" * 150_001] * 20), None), (None, "aaaaaaa aaaaaaa aaaaaaaa aaaaaaaa ×÷ßäöüÿ ×÷ßäöüÿ", "x")]
    return texts


@pytest.mark.parametrize("hot", [2048, 8])
def test_crowded_keys_give_the_same(spark, crowded, hot, monkeypatch):
    monkeypatch.setattr(spelling, "TILE", 16)
    docs = spark.createDataFrame(crowded, "doc_id long, text string, word string")
    assert found(variants(docs, every=10**9, hot=hot)) == expected(crowded, every=10**9)


def test_short_words_and_deletions(spark):
    words = ["a", "b", "ab", "abc", "bc", "abd", "日本", "日本語", "日", "aaab", "aab", "aaaab", "éa", "😀a", "😀"]
    table = spark.createDataFrame([(w, 2 + k) for k, w in enumerate(words)], "word string, n long")
    got = {(r["word"], r["n_near"], r["near_n"], r["near"]) for r in near_words(table).collect()}
    n = {w: 2 + k for k, w in enumerate(words)}
    want = set()
    for w in words:
        others = [v for v in words if one_edit(w, v)]
        if others:
            top = min(others, key=lambda v: (-n[v], v))
            want.add((w, len(others), n[top], top))
    assert got == want


def test_without_words(spark, no_docs):
    assert variants(no_docs).count() == 0
