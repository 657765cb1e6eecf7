"""Token counts against the vocabulary's own library."""

import random

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kerntrail.llm import tokencount
from kerntrail.llm.tokencount import TOKENIZER, Counter, count_tokens, prefix_scan

PARTS = ["a", "b", "e", "'", " ", "  ", "\n", "\t", "'s", "'ll", "'ve", "'re", "'t", "'S", "1", "23", "é", "日本", "ß", "!", "?..", "<|endoftext|>", "<|", "the", " the", "xxxx", " ", "　", "😀", "́", "ing", "tion", "՘", "\r\n", "l", "v", "r", "​", "00000", "²", "Ⅷ", "\0"]


@pytest.fixture(scope="module")
def library():
    own = Tokenizer.from_file(TOKENIZER)
    return lambda texts: [len(e.ids) for e in own.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.fixture(scope="module")
def counter():
    return Counter()


def mixed(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 40))) for _ in range(n)]


@pytest.mark.parametrize("size", [1 << 19, 64, 7, 1])
def test_random_texts_in_slices_of_any_size(counter, library, monkeypatch, size):
    monkeypatch.setattr(tokencount, "SLICE", size)
    texts = [*mixed(3000 if size > 64 else 300, size), "", None, "x" * 3000, "日本語" * 500, " " * 700, "\n" * 77, "'" * 99, "<|endoftext|>" * 3]
    assert counter.count(texts).tolist() == library(texts)


def test_few_states(library, monkeypatch):
    """Beyond the bound of states steps aren't kept, and slices start anew: the counts stay."""
    monkeypatch.setattr(tokencount, "STATES", 50)
    monkeypatch.setattr(tokencount, "PAIRS", 20)
    monkeypatch.setattr(tokencount, "SLICE", 100)
    texts = [*mixed(150, 9), "antidisestablishmentarianism " * 20, "y" * 999]
    assert Counter().count(texts).tolist() == library(texts)


def test_a_very_long_text(counter, library):
    rng = random.Random(2)
    text = " ".join("".join(rng.choice(["al", "be", "co", "du"]) for _ in range(3)) for _ in range(200_000)) + "z" * 100_000
    assert len(text) > 1 << 20 and counter.count([text, text]).tolist() == library([text]) * 2


def test_prefix_scan_equals_one_after_the_other():
    import numpy as np

    maps = np.random.default_rng(1).integers(0, 8, (77, 8)).astype(np.uint8)
    scanned, at = prefix_scan(maps), np.arange(8)
    for own, want in zip(scanned, maps, strict=True):
        at = want[at]
        assert (own == at).all()


def test_operator(spark, edge_docs, edge_rows, library):
    docs = edge_docs.withColumn("n_tokens", F.lit("mine"))
    counted, names = count_tokens(docs)
    got = sorted(((r["doc_id"], r[names["n_bytes"]], r[names["n_tokens"]], r[names["over_limit"]]) for r in counted.collect()), key=repr)
    want = library([r[1] for r in edge_rows])
    assert got == sorted(((r[0], len((r[1] or "").encode()), n, n > 1024) for r, n in zip(edge_rows, want, strict=True)), key=repr)
    assert {r["n_tokens"] for r in counted.collect()} == {"mine"}


def test_without_rows(spark, no_docs):
    assert count_tokens(no_docs)[0].count() == 0


def test_other_vocabularies_are_refused(tmp_path):
    bad = tmp_path / "other.json"
    bad.write_text('{"model": {"type": "BPE", "vocab": {}, "merges": []}, "pre_tokenizer": {"type": "Whitespace"}}')
    with pytest.raises(ValueError):
        Counter(str(bad))
