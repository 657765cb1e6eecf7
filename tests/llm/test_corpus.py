"""Corpus operators against brute force."""

import hashlib
import math
import random
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from tablediff import rows_of
from pyspark.sql import functions as F

from kerntrail.llm import decontamination, language, mixing, packing, registry, repeats, scoring, sharding, simhash, topk, toxicity
from kerntrail.llm.common import fold


def values(df):
    """As pandas, integers beside nulls as they are."""
    return pd.DataFrame([tuple(r) for r in df.collect()], columns=df.columns, dtype=object)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, data, duck, name):
    found, want = values(registry.queries()[name](spark, data)), duck.sql(registry.oracle_sql()[name]).df()
    assert sorted(found.columns) == sorted(want.columns)
    assert rows_of(found) == rows_of(want)


# 1: packing


def test_best_fit_decreasing_equals_a_scan_over_rows():
    rng = random.Random(1)
    for _ in range(30):
        sizes = [rng.randint(1, 50) for _ in range(rng.randint(1, 120))]
        rows = packing.best_fit_decreasing(sizes, 50)
        assert sorted(i for r in rows for i in r) == list(range(len(sizes))) and all(sum(sizes[i] for i in r) <= 50 for r in rows)
        rooms = []
        for s in sorted(sizes, reverse=True):
            fits = [k for k, room in enumerate(rooms) if room >= s]
            if fits:
                rooms[min(fits, key=lambda k: rooms[k])] -= s
            else:
                rooms.append(50 - s)
        assert len(rows) == len(rooms) and sorted(50 - sum(sizes[i] for i in r) for r in rows) == sorted(rooms)


def test_packing_round_trip(edge_docs, edge_rows, no_docs):
    encoder, parts = packing.Encoder(), defaultdict(list)
    for r in packing.pack(edge_docs, context=256).collect():
        ids, at = np.frombuffer(r.ids, "<u2"), np.frombuffer(r.positions, "<u2")
        assert len(ids) == len(at) == 256 and r.n_tokens == r.cu_seqlens[-1] <= 256 and not ids[r.n_tokens :].any() and not at[r.n_tokens :].any()
        assert at[: r.n_tokens].tolist() == [k for a, b in zip(r.cu_seqlens, r.cu_seqlens[1:], strict=False) for k in range(b - a)]
        for doc, start, a, b in zip(r.doc_ids, r.doc_starts, r.cu_seqlens, r.cu_seqlens[1:], strict=False):
            parts[doc].append((start, ids[a:b]))
    want = defaultdict(list)
    for row in edge_rows:
        if row[1]:
            want[row[0]].append(row[1])
    for doc, texts in want.items():
        tokens = sum(len(encoder.own.encode_ordinary(t)) for t in texts)
        assert sum(len(x) for _, x in parts[doc]) == tokens
        if len(texts) == 1:
            assert encoder.decode(np.concatenate([x for _, x in sorted(parts[doc], key=lambda p: p[0])])) == texts[0]
    assert set(parts) == set(want) and packing.pack(no_docs).count() == 0


def test_packing_query_on_a_given_table(spark, data):
    docs = pd.read_parquet(f"{data}/documents.parquet")
    encoder, tokens = packing.Encoder(), Counter()
    rows = registry.queries()["op1_packing"](spark, data).collect()
    for r in rows:
        assert len(r.ids) == len(r.positions) == 2 * packing.CONTEXT
        for doc, a, b in zip(r.doc_ids, r.cu_seqlens, r.cu_seqlens[1:], strict=False):
            tokens[doc] += b - a
    want = {d: len(encoder.own.encode_ordinary(t)) for d, t in zip(docs.doc_id, docs.text, strict=True)}
    assert tokens == {d: n for d, n in want.items() if n}
    assert sum(r.n_tokens for r in rows) > 0.97 * len(rows) * packing.CONTEXT


def test_chunks_encode_like_whole_texts():
    encoder = packing.Encoder()
    for text in ["a  b\n\n c\t\td  ", "it's 12 x's  \n", " ", "é　日 本!!  ?? \r\n x", "I'LL we've'd"]:
        assert np.frombuffer(encoder.encode(text), "<u2").tolist() == encoder.own.encode_ordinary(text)


# 2: decontamination


def brute_contamination(text, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    w, hit, found = words(text), set(), set()
    for key, item in items:
        v = words(item)
        for i in range(max(1, len(v) - 12) if v else 0):
            window = v[i : i + 13]
            for k in range(len(w) - len(window) + 1):
                if w[k : k + len(window)] == window:
                    hit |= set(range(k, k + len(window)))
                    found |= {str(key)} if key is not None else set()
    return len(w), len(hit), sorted(found)


ITEMS = [(1, "Al be; CO du en"), (11, "al be co du en fi go ha is jo ka lo al be co"), (2, ""), (3, None), (None, "fi go"), (4, "日本語のテキスト"), (11, "al be co du en fi go ha is jo ka lo al be co")]


def test_contamination(spark, edge_docs, edge_rows, no_docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    planted = edge_docs.select("doc_id", "text").union(spark.createDataFrame([(900, "xx AL be co, du en fi go ha is jo ka lo al be co al be co du en zz " + "q " * 50)], "doc_id long, text string"))
    got = decontamination.contains(planted, items).withColumn("n_hit", decontamination.hit_words(F.col("runs"))).collect()
    rows = [(r[0], r[1]) for r in edge_rows] + [(900, planted.filter("doc_id = 900").first().text)]
    want = sorted((d if d is not None else -1, *brute_contamination(t, ITEMS)) for d, t in rows)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.n_hit, r["items"]) for r in got) == want
    text = dict(rows)[900]
    spans = [text[s.first : s.behind] for r in got if r.doc_id == 900 for s in r.spans]
    assert spans == ["AL be co, du en fi go ha is jo ka lo al be co al be co du en"]
    assert decontamination.contains(no_docs, items).count() == 0
    assert decontamination.contains(edge_docs, items.limit(0)).filter("size(runs) > 0").count() == 0


def test_decontaminate_keeps_clean_rows_and_columns(spark, edge_docs):
    items = spark.createDataFrame([(1, "日本語のテキスト")], "item_id long, text string")
    kept = decontamination.decontaminate(edge_docs, items)
    assert kept.columns == edge_docs.columns and kept.count() == edge_docs.count() - 1 and kept.filter("doc_id = 7").count() == 0


@pytest.mark.parametrize("block", [1, decontamination.BLOCK_BYTES])
def test_several_automata_judge_rows_alone(spark, edge_docs, edge_rows, monkeypatch, block):
    """Null and repeated ids stay rows of their own; contaminated and clean rows of one id go and stay alone."""
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    more = [(5, "fi go al be co du en"), (None, "fi go"), (None, "q q q"), (None, "日本語のテキスト")]
    rows = [(r[0], r[1]) for r in edge_rows] + more
    docs = edge_docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    monkeypatch.setattr(decontamination, "NODES", 78)
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", block)
    chunks = list(decontamination.item_chunks(items, nodes=78))
    assert len(chunks) > 1 and all(sum(len(decontamination.windows(decontamination.normal_words(t), 13)) for _, t in c) <= 2 for c in chunks)
    judged = [(d, t, *brute_contamination(t, ITEMS)) for d, t in rows]
    got = decontamination.contains(docs, items).withColumn("n_hit", decontamination.hit_words(F.col("runs"))).collect()
    assert sorted(str((r.doc_id, r.n_words, r.n_hit, r["items"])) for r in got) == sorted(str((d, *x)) for d, _, *x in judged)
    kept = decontamination.decontaminate(docs, items).collect()
    assert sorted(str((r.doc_id, r.text)) for r in kept) == sorted(str((d, t)) for d, t, n, hit, _ in judged if not (hit and 20 * hit >= n))


# 3: repeats


def brute_repeats(raws, n=200):
    seen = Counter(raw[k : k + n] for raw in raws for k in range(len(raw) - n + 1))
    for raw in raws:
        mask = np.zeros(len(raw), bool)
        for k in range(len(raw) - n + 1):
            if seen[raw[k : k + n]] > 1:
                mask[k : k + n] = True
        runs = int((np.diff(np.concatenate(([0], mask.astype(int)))) == 1).sum())
        yield len(raw), int(mask.sum()), runs, hashlib.sha256(np.frombuffer(raw, np.uint8)[~mask].tobytes()).hexdigest()


def planted_repeats(spark):
    rng = random.Random(9)
    word = lambda n: " ".join("".join(rng.choice("abcdéfgh") for _ in range(rng.randint(1, 7))) for _ in range(n))
    passage, other = word(60), word(90)
    rows = [(k, word(rng.randint(0, 60)) + (passage if k % 2 else other[k : k + 260]) + word(rng.randint(0, 50))) for k in range(40)]
    rows += [(50, "ab" * 150), (51, "ab" * 99), (52, "a" * 200), (53, "a" * 201), (54, passage[:199]), (55, None), (56, ""), (57, rows[3][1]), (57, rows[3][1]), (None, rows[5][1]), (58, "xyz" * 4000 + passage)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


@pytest.mark.parametrize(("hot", "most", "few"), [(repeats.HOT, repeats.ROWS, 9), (repeats.HOT, 1, 9), (1, repeats.ROWS, 10**6), (1, 1, 0), (1000, 3, 10**6)])
def test_repeats(spark, hot, most, few, monkeypatch):
    rows, docs = planted_repeats(spark)
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "ROWS", most)
    monkeypatch.setattr(repeats, "BROADCAST_ROWS", few)
    got = repeats.remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", F.size("spans").alias("n"), F.sha2("kept", 256).alias("h")).collect()
    want = brute_repeats([(t or "").encode() for _, t in rows])
    key = lambda r: (-1 if r[0] is None else r[0], *r[1:])
    assert sorted(map(key, got)) == sorted(key((d, *w)) for (d, _), w in zip(rows, want, strict=True))


def test_repeats_in_awkward_rows(edge_docs, edge_rows, no_docs):
    got = repeats.remove_repeats(edge_docs).select("n_bytes", "n_removed", F.size("spans").alias("n"), F.sha2("kept", 256).alias("h")).collect()
    assert sorted(map(tuple, got)) == sorted(brute_repeats([(r[1] or "").encode() for r in edge_rows]))
    assert repeats.remove_repeats(no_docs).count() == 0


@pytest.mark.parametrize(("size", "bits"), [(5_000, (10,)), ((16 << 20) + 70_000, ())])
def test_keys_behind_the_place_field(size, bits):
    """A passage has the same keys behind 2 ** bits bytes of a text as alone, and each window of the text is in one segment."""
    import pyarrow as pa

    rng = np.random.default_rng(14)
    letters = lambda n: rng.integers(97, 123, n, np.uint8).tobytes().decode()
    passage = letters(900)
    texts = [letters(size) + passage + letters(300), passage, letters(150)]
    batch = pa.record_batch([pa.array([0, 1, 2]), pa.array([0, 0, 0], pa.int32()), pa.array(texts)], ["row_key", "start", "text"])
    found = [r for part in repeats.cut(repeats.GRAMS[0], "text", *bits)(iter([batch])) for r in zip(*[part[c].to_pylist() for c in ("row_key", "place", "key")], strict=True)]
    runs = sorted((row, place >> 32, (place & 0xFFFFFFFF) >> 1, key) for row, place, key in found)
    for row, text in enumerate(texts):
        own = [(a, n) for r, a, n, _ in runs if r == row]
        ends = [0, *(a + n - 199 for a, n in own)]
        assert [a for a, _ in own] == ends[:-1] and ends[-1] == max(0, len(text) - 199)
    keys = [{k - base: key for r, a, n, key in runs if r == row for k in range(max(a, base), min(a + n - 199, base + 701))} for row, base in ((0, size), (1, 0))]
    assert len(keys[1]) == 701 and keys[0] == keys[1]


@pytest.mark.parametrize("size", [repeats.HASHED, repeats.HASHED + 150, 2 * repeats.HASHED + 500])
def test_repeats_of_long_texts(spark, size):
    """Passages across and behind the cuts of a long text, which stand in short texts too."""
    rng = np.random.default_rng(15)
    letters = lambda n: rng.integers(97, 123, n, np.uint8).tobytes().decode()
    long = letters(size)
    spots = [(a, min(a + 500, size)) for a in (0, repeats.HASHED - 300, repeats.HASHED - 199, size - 400) if min(a + 500, size) - a >= 200]
    rows = [(1, long), *((10 + k, "!" + long[a:b] + "?") for k, (a, b) in enumerate(spots))]
    got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).filter("doc_id = 1").first()
    assert got.n_bytes == size and [(s >> 32, s & 0xFFFFFFFF) for s in got.spans] == decontamination.covered(spots)


def test_maximal_repeats_are_those_of_the_definition():
    rng = random.Random(3)
    contents = ["".join(rng.choice("ab") for _ in range(rng.randint(200, 215))).encode() for _ in range(3)]
    contents += [b"x" + contents[0], contents[1][:205] + b"yy" + contents[1][:203], b"q" * 230]
    got = {(n, tuple(sorted(zip(owner.tolist(), place.tolist(), strict=True)))) for n, owner, place, _ in repeats.repeats(contents)}
    want, at = set(), [(c, k) for c, x in enumerate(contents) for k in range(len(x))]
    by_text = defaultdict(list)
    for c, k in at:
        for n in range(200, len(contents[c]) - k + 1):
            by_text[contents[c][k : k + n]].append((c, k))
    for text, own in by_text.items():
        left = {contents[c][k - 1] if k else (c, k) for c, k in own}
        right = {contents[c][k + len(text)] if k + len(text) < len(contents[c]) else (c, k) for c, k in own}
        if len(own) > 1 and len(left) > 1 and len(right) > 1:
            want.add((len(text), tuple(sorted(own))))
    assert got == want and want


# 4: scoring


def brute_scores(rows, held):
    tokens = [(t or "").encode().lower().split() for _, t in rows]
    unigrams, bigrams = Counter(), Counter()
    for (d, _), ws in zip(rows, tokens, strict=True):
        if not held(d):
            seq = [None, *ws, 0]
            unigrams.update(seq[1:])
            bigrams.update(zip(seq, seq[1:], strict=False))
    n, v = sum(unigrams.values()), len(unigrams)
    contexts, behind = Counter(w for _, w in bigrams), defaultdict(lambda: [0, 0, 0, 0])
    for (u, _), c in bigrams.items():
        behind[u][0] += c
        behind[u][min(c, 3)] += 1
    d, e = ([0, *scoring.discounts([sum(c == k for c in x.values()) for k in (1, 2, 3, 4)])] for x in (bigrams, contexts))
    left = sum(e[min(c, 3)] for c in contexts.values())
    low = lambda w: (contexts[w] - e[min(contexts[w], 3)]) / len(bigrams) + left / len(bigrams) / (v + 1) if bigrams else 1.0
    if bigrams:
        assert abs(sum(map(low, unigrams)) + left / len(bigrams) / (v + 1) - 1) < 1e-9
    for ws in tokens:
        base = score = known = 0
        for u, w in zip([None, *ws], [*ws, 0], strict=True):
            base += math.log10((unigrams[w] + 1) / (n + v + 1))
            known += unigrams[w] > 0
            c, x = bigrams[u, w], behind.get(u)
            score += math.log10((c - d[min(c, 3)] + sum(d[k] * x[k] for k in (1, 2, 3)) * low(w)) / x[0] if x else low(w))
        yield len(ws) + 1, known, round(base, 6), round(score, 6)


@pytest.mark.parametrize("learned", [True, False])
def test_scores(edge_docs, edge_rows, learned):
    rule = (fold(F.col("doc_id"), 3) != 0) if learned else F.lit(False)
    docs = edge_docs.select("doc_id", "text")
    got = scoring.score(docs, scoring.fit(docs, rule)).collect()
    held = lambda d: not learned or zlib.crc32(b"" if d is None else str(d).encode()) % 3 == 0
    want = brute_scores([(r[0], r[1]) for r in edge_rows], held)
    assert np.allclose(sorted((r.n_tokens, r.n_known, r.base_score, r.score) for r in got), sorted(want), atol=1e-5)


@pytest.mark.parametrize("fan", [scoring.FAN, 4])
def test_scores_with_many_shards_and_hot_contexts(edge_docs, monkeypatch, fan):
    """Also where blocks go to groups of shards first."""
    monkeypatch.setattr(scoring, "FAN", fan)
    docs = edge_docs.select("doc_id", "text").filter("doc_id > 0")
    plain = scoring.score(docs, scoring.fit(docs, F.lit(True)))
    want = {(r.doc_id, r.n_tokens): r.score for r in plain.collect()}
    monkeypatch.setattr(scoring, "SHARD_BYTES", 4000)
    monkeypatch.setattr(scoring, "HOT_SHARE", 0.0001)
    monkeypatch.setattr(scoring, "COUNT_TOKENS", 500)
    got = scoring.score(docs, scoring.fit(docs, F.lit(True))).collect()
    assert all(abs(want[r.doc_id, r.n_tokens] - r.score) < 1e-6 for r in got)


def brute_ngram_scores(texts, order):
    """Interpolated modified Kneser-Ney of any order, by plain counting of grams as tuples."""
    seqs = [[None, *(t or "").encode().lower().split(), 0] for t in texts]
    counts = {k: Counter() for k in range(1, order + 1)}
    for seq in seqs:
        counts[order].update(tuple(seq[i : i + order]) for i in range(len(seq) - order + 1))
        for k in range(2, order):
            if len(seq) >= k:
                counts[k][tuple(seq[:k])] += 1
    for k in range(order - 1, 0, -1):
        counts[k].update(gram[1:] for gram in counts[k + 1])
    d = {k: [0, *scoring.discounts([sum(c == j for c in x.values()) for j in (1, 2, 3, 4)])] for k, x in counts.items()}
    behind = defaultdict(lambda: [0, 0.0])  # what a context counts, and what its discounts take
    for k in counts:
        for gram, c in counts[k].items():
            behind[k, gram[:-1]][0] += c
            behind[k, gram[:-1]][1] += d[k][min(c, 3)]

    def probability(gram):
        k = len(gram)
        lower = probability(gram[1:]) if k > 1 else 1 / (len(counts[1]) + 1)
        found = behind.get((k, gram[:-1]))
        if not found:
            return lower
        c = counts[k][gram]
        return (c - d[k][min(c, 3)] + found[1] * lower) / found[0]

    context = next(seq for seq in seqs if len(seq) > 20)[5 : 4 + order]
    vocabulary = [w for (w,) in counts[1]] + ["unknown"]
    assert abs(sum(probability((*context, w)) for w in vocabulary) - 1) < 1e-9
    for seq in seqs:
        yield len(seq) - 1, round(sum(math.log10(probability(tuple(seq[max(0, i - order + 1) : i + 1]))) for i in range(1, len(seq))), 6)


@pytest.mark.parametrize("order", [2, 3, 4])
@pytest.mark.parametrize("many", [False, True])
def test_scores_of_any_order(edge_docs, edge_rows, monkeypatch, order, many):
    """Also in many shards, by way of groups, with contexts spread over shards and blocks of few tokens."""
    if many:
        for name, value in {"SHARD_BYTES": 40_000, "FAN": 4, "HOT_SHARE": 0.001, "COUNT_TOKENS": 2_000}.items():
            monkeypatch.setattr(scoring, name, value)
    docs = edge_docs.select("doc_id", "text")
    got = scoring.score(docs, scoring.fit(docs, F.lit(True), order)).collect()
    want = sorted(brute_ngram_scores([r[1] for r in edge_rows], order))
    assert np.allclose(sorted((r.n_tokens, r.score) for r in got), want, atol=1e-5)
    assert {r.n_known for r in got if r.n_tokens == 1} == {1}


@pytest.mark.parametrize("order", [2, 3])
def test_scores_of_a_text_of_two_megabytes(spark, monkeypatch, order):
    """A text beyond what a task counts and scores at once, a word of a megabyte, and a short text beside them."""
    monkeypatch.setattr(scoring, "COUNT_TOKENS", 50_000)
    monkeypatch.setattr(scoring, "SCORE_TOKENS", 50_000)
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{k}" for k in rng.zipf(1.3, 300_000) % 5_000), "z" * (1 << 20), "w1 w2 w3"]
    assert len(texts[0]) > 1 << 20
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = scoring.score(docs, scoring.fit(docs, F.lit(True), order)).collect()
    assert np.allclose(sorted((r.n_tokens, r.score) for r in got), sorted(brute_ngram_scores(texts, order)), rtol=1e-9, atol=1e-5)


def test_order_under_two_is_refused(edge_docs):
    with pytest.raises(ValueError):
        scoring.fit(edge_docs.select("doc_id", "text"), F.lit(True), 1)


def test_wide_counts_are_whole():
    c = np.array([1, 1 << 33, 7])
    assert (scoring.counts_in(scoring.narrow(c).view(np.uint8), 3) == c).all() and scoring.narrow(c[:1]).dtype == np.uint32
    columns = [np.array([3, 1, 3], np.uint64), np.array([5, 5, 9], np.uint64), np.array([2, 2, 2], np.uint64)]
    (_, to, data, *_), *rest = scoring.gram_blocks(columns, c, np.zeros(3, np.int64))
    assert not rest and to == 0
    got = scoring.grams_of(data, 3)
    assert sorted(zip(*(x.tolist() for x in got), strict=True)) == sorted(zip(*(x.tolist() for x in (*columns, c)), strict=True))


def test_scores_of_nothing(no_docs):
    docs = no_docs.select("doc_id", "text")
    assert scoring.score(docs, scoring.fit(docs, F.lit(True))).count() == 0


# 5: top k


def test_top_k(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(k, [float(v) for v in rng.normal(size=5)]) for k in range(300)]
    rows += [(500, rows[3][1]), (501, rows[3][1]), (502, None), (503, [1.0, None, 2.0, 0.0, 0.0]), (504, [float("nan")] * 5), (505, [float("inf")] * 5), (None, [1.0] * 5), (550, [0.5, 0.5]), (551, [0.1, 0.2]), (500, rows[3][1]), (600, [])]
    vectors = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3))
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    got = sorted(map(tuple, topk.top_k(vectors, vectors.filter("vec_id % 50 = 0")).collect()))
    good = [(i, np.floor(256 * np.array(x, np.float32).astype(float))) for i, x in rows if i is not None and x is not None and None not in x and np.isfinite(x).all()]
    want = set()
    for q, x in good:
        if q % 50 == 0:
            best = sorted((-int(x @ y), i) for i, y in good if i != q and len(x) == len(y))[:5]
            want |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    assert got == sorted(want)
    for some, asked in [(vectors.limit(0), vectors.limit(0)), (vectors, vectors.limit(0)), (vectors.limit(0), vectors)]:
        assert topk.top_k(some, asked).count() == 0


def test_top_k_of_awkward_rows(spark):
    """Null, empty, non-finite and repeated vectors, ties, and columns named as its own."""
    nan, inf = float("nan"), float("inf")
    rows = [(50, [1.0, 2.0]), (50, [1.0, 2.0]), (7, [3.0, 1.0]), (7, [3.0, 1.0]), (3, [1.0, 2.0]), (None, [9.0, 9.0]), (4, None), (5, [None, 9.0]), (6, [nan, 9.0]), (8, [inf, 9.0]), (9, []), (100, []), (150, None), (200, [nan, 1.0])]
    vectors = spark.createDataFrame([(*r, "mine") for r in rows], "vec_id long, x array<double>, d string").withColumns({c: F.lit("mine") for c in ("score", "rank", "query_id")})
    got = sorted(map(tuple, topk.top_k(vectors, vectors.filter("vec_id % 50 = 0")).collect()))
    assert got == [(50, 1, 3, 5), (50, 2, 7, 5), (50, 3, 7, 5), (100, 1, 9, 0)]


def test_top_k_of_great_numbers(spark):
    """Scores beyond 2 ** 53 stay exact: they differ in their last digits alone."""
    base = [float(1 << 27), float((1 << 27) - 1), 3.0]
    rows = [(50, base), *((k, [base[0], base[1], float(k)]) for k in range(1, 9))]
    vectors = spark.createDataFrame(rows, "vec_id long, x array<double>")
    got = [(r["rank"], r.vec_id, r.score) for r in topk.top_k(vectors, vectors.filter("vec_id = 50")).orderBy("rank").collect()]
    assert got == [(r + 1, 8 - r, sum(int(a) * int(b) for a, b in zip(base, rows[8 - r][1], strict=True))) for r in range(5)]


def test_pivots_are_far_apart_and_candidates_eliminated():
    rng = np.random.default_rng(5)
    x = np.floor(rng.normal(size=(40, 8)) * 2000)[rng.integers(0, 40, 4000)] + rng.integers(-30, 30, (4000, 8))
    pivots = topk.farthest_first(x[:500].tolist(), 24)
    assert len(np.unique(pivots, axis=0)) == 24
    search = topk.Search(np.arange(0, 4000, 50), x[::50], pivots, 5)
    search.see(np.arange(4000), x, topk.distances(x, pivots))
    assert search.evaluated < 0.5 * search.met
    for q in range(80):
        order = sorted((-int(x[50 * q] @ x[i]), i) for i in range(4000) if i != 50 * q)[:5]
        assert search.found[q].tolist() == [i for _, i in order] and search.scores[q].tolist() == [-v for v, _ in order]


# 6: language


def brute_language(rows, learned):
    """Word and n-gram frequencies by plain loops, without any limit of what is kept."""
    split = lambda t: [w for w in re.split("[\x00-\x60\x7B-\x7F]+", t.lower()) if w]
    langs = sorted({r[2] for r in learned})
    words, grams = {k: Counter() for k in langs}, {k: [Counter() for _ in range(5)] for k in langs}
    for _, text, lang in learned:
        words[lang].update(split(text))
    for lang in langs:
        for w in words[lang]:
            for k in range(1, 5):
                f = f" {w} "
                grams[lang][k].update(f[i : i + k] for i in range(max(1, len(f) - k + 1)))
    known = set().union(*words.values())
    in_size = [set().union(*(grams[g][k] for g in langs)) for k in range(5)]
    value = lambda c, key, kinds: math.log((c[key] + 0.5) / (sum(c.values()) + 0.5 * (kinds + 1)))
    memo = {}
    for doc, text in rows:
        if text is None or not any(unicodedata.category(c).startswith("L") for c in text):
            yield doc, "und", 0.0
            continue
        total = [0.0] * len(langs)
        for w in split(text):
            if w not in memo:
                memo[w] = [0.0] * len(langs)
                if w in known:
                    memo[w] = [value(words[g], w, len(known)) for g in langs]
                else:
                    for k in (4, 3, 2, 1):
                        f = f" {w} "
                        seen = [f[i : i + k] for i in range(len(f) - k + 1) if f[i : i + k] in in_size[k]]
                        if seen:
                            memo[w] = [sum(value(grams[g][k], x, len(in_size[k])) for x in seen) / len(seen) for g in langs]
                            break
            total = [a + b for a, b in zip(total, memo[w], strict=True)]
        best = max(range(len(langs)), key=lambda i: (total[i], -i))
        yield doc, langs[best], 1 / sum(math.exp(t - total[best]) for t in total)


def test_language_equals_plain_loops(spark, data):
    docs = pd.read_parquet(f"{data}/documents.parquet")
    rows = list(zip(docs.doc_id.tolist(), docs.text.tolist(), docs.lang.tolist(), strict=True))
    learned = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2 and r[1] is not None and r[2] is not None]
    got = {r.doc_id: (r.lang_pred, r.score) for r in registry.queries()["op6_language"](spark, data).collect()}
    for doc, lang, score in brute_language([r[:2] for r in rows], learned):
        assert got[doc][0] == lang and abs(got[doc][1] - score) < 1e-3, doc


def test_numeric_signs_are_no_letters(spark, edge_docs):
    model = language.fit(edge_docs, F.lit(True))
    texts = ["½ ² Ⅷ ①", "12_3 ...", "ª", "ß", "٣"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in language.identify(docs, model).collect()}
    assert [got[k] == "und" for k in range(5)] == [True, True, False, False, True]
    assert sorted(r.doc_id for r in language.keep_known(docs, model).collect()) == [2, 3]


def test_language_held_out_accuracy(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    found = registry.queries()["op6_language"](spark, data).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = found[found.held_out]
    assert len(held) > 20 and (held.lang == held.lang_pred).mean() > 0.9 and found.score.between(0, 1).all()


def test_language_of_awkward_rows(edge_docs, no_docs):
    model = language.fit(edge_docs, F.lit(True))
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(edge_docs, model).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[6][0] == "fr" and 0 <= got[7][1] <= 1 and got[7][0] in ("de", "en", "fr")
    assert language.identify(no_docs, model).count() == 0
    nothing = language.fit(no_docs, F.lit(True))
    assert {r.lang_pred for r in language.identify(edge_docs, nothing).collect()} == {"und"}
    kept = language.keep_known(edge_docs, model)
    assert kept.columns == edge_docs.columns and kept.filter("doc_id IN (1, 2, 3)").count() == 0


def test_backoff_uses_the_longest_known_grams():
    model = {"langs": ["x", "y"], "table": {b"word": 0, b"\0 ab ": 1, b"\0a": 2}, "scores": np.log(np.array([[0.9, 0.1], [0.2, 0.8], [0.7, 0.3]], np.float32))}
    predict = language.Predictor(model)
    assert predict("word")[0] == "x" and predict("ab")[0] == "y" and predict("za")[0] == "x" and predict("zz") == ("x", 0.5)


# 7: sharding


def brute_least_cost(supply, room):
    """Bytes that must leave their shard when staying is free and any move costs one."""
    return sum(max(0, s - (room[i] if i < len(room) else 0)) for i, s in enumerate(supply))


def test_flow_moves_the_fewest_bytes():
    rng = random.Random(4)
    for _ in range(40):
        a, b = rng.randint(1, 6), rng.randint(1, 6)
        supply = [rng.randint(0, 30) for _ in range(a)]
        room = [sum(supply) * (j + 1) // b - sum(supply) * j // b for j in range(b)]
        flow = sharding.least_cost_flow(supply, room, lambda i, j: int(i != j))
        assert [sum(n for (i, _), n in flow.items() if i == k) for k in range(a)] == supply
        assert all(sum(n for (_, j), n in flow.items() if j == k) <= room[k] for k in range(b))
        assert sum(n for (i, j), n in flow.items() if i != j) == brute_least_cost(supply, room)


def test_shards_are_near_equal_and_slots_gapless(spark, data):
    found = registry.queries()["op7_sharding"](spark, data).toPandas()
    docs = pd.read_parquet(f"{data}/documents.parquet")
    assert sorted(found.doc_id) == sorted(docs.doc_id)
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in found.groupby("shard"))
    merged = found.merge(docs, on="doc_id")
    assert (merged["size"] == merged.text.map(lambda t: len(t.encode()) + 16)).all() and (merged.text_crc32 == merged.text.map(lambda t: zlib.crc32(t.encode()))).all()
    sizes = found.groupby("shard")["size"].sum().reindex(range(40), fill_value=0)
    assert sizes.max() - sizes.min() <= found["size"].max() and (found.law == "bytes").all() and found.grown_shard.isna().all()


def test_reshard_awkward_rows(edge_docs, no_docs, tmp_path, spark):
    placed, names = sharding.reshard(edge_docs, shards=3, old_shards=2)
    rows = placed.collect()
    assert len(rows) == edge_docs.count() and set(edge_docs.columns) <= set(placed.columns) and names["shard"] == "_shard"
    for shard in range(3):
        assert sorted(r[names["slot"]] for r in rows if r[names["shard"]] == shard) == list(range(sum(r[names["shard"]] == shard for r in rows)))
    assert sharding.reshard(no_docs)[0].count() == 0
    sharding.rewrite(placed, names, str(tmp_path / "out"))
    touched = {r.shard for r in sharding.affected(placed, names).collect()}
    assert spark.read.parquet(str(tmp_path / "out")).count() == sum(r[names["shard"]] in touched for r in rows)


def test_whole_blocks_move_few_bytes_more_than_the_flow(spark, data):
    placed, names = sharding.reshard(spark.read.parquet(f"{data}/documents.parquet"), shards=12, old_shards=8)
    rows = placed.toPandas()
    supply = rows.groupby(names["old_shard"])[names["size"]].sum().reindex(range(8), fill_value=0).tolist()
    total = sum(supply)
    least = brute_least_cost(supply, [total * (j + 1) // 12 - total * j // 12 for j in range(12)])
    moved = sum(r["bytes"] for r in sharding.moved_bytes(placed, names).collect())
    assert least - rows[names["size"]].max() <= moved <= 1.05 * least


def test_rewriting_nulls_ties_and_repeated_rows(spark, tmp_path):
    """Null ids and texts, equal texts and equal rows, and a column named shard: every row is there once after it, and after it again."""
    rows = [(None, None, "a"), (None, None, "a"), (1, None, "b"), (1, "same", None), (1, "same", None), (2, "same", "c"), (3, "", "c"), *((10 + k, f"text {k} " * 9, "d") for k in range(40))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, slot string")
    path, ordered = str(tmp_path / "out"), lambda found: sorted(found, key=str)
    docs.withColumn("shard", F.pmod(F.xxhash64("text"), F.lit(5)).cast("int")).write.partitionBy("shard").parquet(path)
    placed, names = sharding.reshard(docs, shards=3, old_shards=5, blocks=64)
    want = ordered((r.doc_id, r.text, r.slot, r[names["shard"]]) for r in placed.collect())
    assert ordered(w[:3] for w in want) == ordered(rows)
    for _ in range(2):
        sharding.rewrite(placed, names, path)
        assert ordered((r.doc_id, r.text, r.slot, r.shard) for r in spark.read.parquet(path).collect()) == want


def test_rewriting_leaves_what_the_plan_says(spark, tmp_path):
    """Files written by their old shards, then rewritten for fewer and for more: each row stands once, where it was put."""
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.repeat(F.concat(F.lit("t"), F.col("id").cast("string")), 20).alias("text"))
    for shards in (3, 11):
        path = str(tmp_path / f"to{shards}")
        docs.withColumn("shard", F.pmod(F.xxhash64("text"), F.lit(8)).cast("int")).write.partitionBy("shard").parquet(path)
        placed, names = sharding.reshard(docs, shards=shards, old_shards=8, blocks=64)
        want = sorted((r.doc_id, r[names["shard"]]) for r in placed.collect())
        sharding.rewrite(placed, names, path)
        got = spark.read.parquet(path)
        assert sorted((r.doc_id, r.shard) for r in got.collect()) == want
        sharding.rewrite(placed, names, path)
        assert spark.read.parquet(path).count() == 60


def test_a_hot_text_is_split(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 150, F.lit("same " * 20)).otherwise(F.concat(F.lit("t "), F.repeat(F.col("id").cast("string"), 30))).alias("text"))
    placed, n = sharding.reshard(docs, shards=8)
    sizes = [r["sum(size)"] for r in placed.groupBy(n["shard"]).agg(F.sum("size")).collect()]
    assert len(sizes) == 8 and max(sizes) < 1.1 * min(sizes)


# 8: mixing


def brute_targets(sizes, weights=(3, 1, 2)):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    target, open_, rest = {}, set(order), 1.5 * sum(sizes.values())
    while open_:
        level = rest / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] > 2 * sizes[s]}
        if not over:
            return target | {s: level * w[s] for s in open_}
        for s in over:
            target[s] = 2.0 * sizes[s]
            rest -= target[s]
        open_ -= over
    return target


def test_mixing(edge_docs, edge_rows, no_docs):
    mixed, n = mixing.mix(edge_docs)
    rows = mixed.collect()
    sizes = Counter()
    for r in edge_rows:
        sizes[r[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    want = brute_targets(sizes)
    assert len(rows) == len(edge_rows) and n["size"] == "_size"
    for r in rows:
        rate = want[r.source] / sizes[r.source] if sizes[r.source] else 0
        assert abs(r[n["target"]] - want[r.source]) < 1e-6 and r[n["source_size"]] == sizes[r.source]
        assert r[n["copies"]] in (math.floor(rate), math.floor(rate) + 1) and r[n["copies"]] <= 2
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(edge_docs)[0].collect()))
    assert mixing.mix(no_docs)[0].count() == 0
    out = mixing.emit(edge_docs)
    assert out.columns == edge_docs.columns and out.count() == sum(r[n["copies"]] for r in rows)


def test_mixing_comes_near_its_targets(spark, monkeypatch):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 7).cast("int")).alias("text"), F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 5).cast("string"))).alias("source"))
    for most in (10_000, 2):
        monkeypatch.setattr(mixing, "BROADCAST_SOURCES", most)
        mixed, n = mixing.mix(docs)
        taken = mixed.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("t"), F.max("target").alias("g")).collect()
        assert len(taken) == 6 and all(abs(r.t - r.g) < 0.05 * r.g for r in taken)


# 9: SimHash


def brute_fingerprint(text, width=4):
    import xxhash

    words = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return 0
    hashes = [xxhash.xxh64(" ".join(words[i : i + width]).encode(), seed=42).intdigest() for i in range(max(1, len(words) - width + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_agree_with_spark(spark, edge_rows):
    for r in edge_rows:
        assert simhash.fingerprint(r[1]) == brute_fingerprint(r[1])
    one = spark.sql("SELECT xxhash64('a b c d') AS h").first().h
    assert simhash.fingerprint("A b\tC d") == one & (1 << 64) - 1


def brute_components(ids, fps):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 4:
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(ids)):
        groups[find(i)].append(ids[i])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    return [least[find(i)] for i in range(len(ids))]


def test_near_duplicates(edge_docs, edge_rows, no_docs):
    got = simhash.near_duplicates(edge_docs).collect()
    fps = [brute_fingerprint(r[1]) for r in edge_rows]
    want = zip([r[0] for r in edge_rows], fps, brute_components([r[0] for r in edge_rows], fps), strict=True)
    assert sorted(map(str, ((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in got))) == sorted(map(str, want))
    assert simhash.near_duplicates(no_docs).count() == 0
    kept = simhash.deduplicate(edge_docs)
    assert kept.columns == edge_docs.columns and kept.count() == len({str(r.component_id) for r in got})


def test_deduplicate_judges_rows_not_ids(spark):
    """Null ids and one id on different texts: each component keeps one row, and only rows equal in id and text are one."""
    rng = random.Random(12)
    a, b, c, d, e = ("".join(rng.choice("abcdefgh ") for _ in range(900)) for _ in range(5))
    rows = [(None, a), (None, b), (None, b), (7, c), (7, d), (7, d), (3, d), (8, e), (None, e), (None, None)]
    kept = simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, [(None, a), (None, b), (7, c), (3, d), (8, e), (None, None)]))


@pytest.mark.parametrize(("n", "most"), [(8, None), (10_000_000, None), (8, 20)])
def test_links_join_chains_and_dense_groups(spark, n, most):
    """Chains of steps of four bits, dense groups, and fingerprints at five bits, under few and many grid projections."""
    rng = random.Random(6)
    fps = [rng.getrandbits(64) for _ in range(150)]
    for k in range(60):
        fps.append(fps[-1] ^ sum(1 << b for b in rng.sample(range(64), 4)))
    centre = rng.getrandbits(64)
    fps += [centre ^ sum(1 << b for b in rng.sample(range(12), 3)) for _ in range(150)] + [centre ^ (0b11111 << 50), 0, 1, (1 << 64) - 1]
    fps = sorted(set(fps))
    table = spark.createDataFrame([(simhash.signed(f),) for f in fps], "fp long").repartition(3)
    edges = simhash.links(table, n, most=most)
    root = {r.node: r.root for r in simhash.components(edges).collect()}
    labels = [root.get(simhash.signed(f), simhash.signed(f)) for f in fps]
    want = brute_components([simhash.signed(f) for f in fps], fps)
    assert len(set(zip(labels, want, strict=True))) == len(set(labels)) == len(set(want))


def test_large_cells():
    """Searches connect what brute force connects, whether members are few or many."""
    rng = np.random.default_rng(2)
    fps = np.unique(np.concatenate([np.full(700, 77, np.uint64) ^ rng.integers(0, 1 << 13, 700).astype(np.uint64), rng.integers(0, 1 << 63, 300).astype(np.uint64)]))
    a, b = simhash.search(fps, 4)
    root = dict(zip(a.tolist(), b.tolist(), strict=True))
    got = [root.get(f, f) for f in fps.tolist()]
    want = brute_components(fps.tolist(), fps.tolist())
    assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))


def test_popcount_codes_differ_by_the_manhattan_distance(spark):
    rng = np.random.default_rng(3)
    fps = rng.integers(0, 1 << 64, 200, dtype=np.uint64)
    table = spark.createDataFrame([(simhash.signed(int(f)),) for f in fps], "fp long")
    codes = np.array([r.c & (1 << 64) - 1 for r in table.select(simhash.popcounts(F.col("fp")).alias("c")).collect()], np.uint64)
    assert (codes == simhash.embedded(fps)).all()
    counts = np.array([[bin(int(f) >> 2 * k & 3).count("1") for k in range(32)] for f in fps])
    manhattan = np.abs(counts[:100] - counts[100:]).sum(axis=1)
    assert (np.bitwise_count(codes[:100] ^ codes[100:]) == manhattan).all() and (manhattan <= np.bitwise_count(fps[:100] ^ fps[100:])).all()


# 10: toxicity


def toxic_rows(spark, n=700):
    rng = random.Random(10)
    clean, bad = [f"w{k}" .replace("0", "o") + "abcdefgh"[k % 8] * 2 for k in range(400)], ["gruk", "grukken", "blarg", "blargen"]
    rows, labels = [], []
    for k in range(n):
        words = [rng.choice(clean) for _ in range(rng.randint(3, 80))]
        if k % 6 == 0:
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((k, " ".join(words), "en" if k % 2 else "fr"))
        labels.append((k, int(k % 6 == 0)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_held_out_accuracy(spark):
    docs, labels = toxic_rows(spark)
    held = fold(F.col("doc_id"), 5) == 0
    scored = toxicity.score(docs, toxicity.fit(docs, labels, ~held))
    found = scored.join(labels, "doc_id").filter(held).toPandas()
    assert found.score.between(0, 1).all()
    assert (found[found.toxic == 1].score >= 0.5).mean() > 0.9 and (found[found.toxic == 0].score < 0.5).mean() > 0.95


def test_toxicity_query_on_a_given_table(spark, data):
    """Fold, score and prediction of every document; few errors in the held-out fold of a table with labels enough."""
    given = "/root/testdata/sf0.1"
    found = registry.queries()["op10_toxicity"](spark, given).toPandas()
    docs, labels = pd.read_parquet(f"{given}/documents.parquet", columns=["doc_id"]), pd.read_parquet(f"{given}/labels.parquet")
    assert sorted(found.doc_id) == sorted(docs.doc_id) and found.score.between(0, 1).all()
    assert (found.predicted == (found.score >= 0.5).astype(int)).all()
    assert (found.held_out == found.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % 5 == 0)).all()
    held = found[found.held_out].merge(labels, on="doc_id")
    toxic, clean = held[held.toxic == 1], held[held.toxic == 0]
    assert len(toxic) > 50 and (toxic.predicted == 1).mean() > 0.85 and (clean.predicted == 0).mean() > 0.98


def test_network_equals_plain_loops():
    """Embeddings, filters of three widths, maxima and the output by loops over positions."""
    net = toxicity.Network(3)
    rng = np.random.default_rng(4)
    net.b = [rng.normal(0, 0.1, len(b)).astype(np.float32) for b in net.b]
    for text in ["one", "one two three", "Gruk! gruk-blarg é 12 word"]:
        words = [b""] * 2 + language.letters(text) + [b""] * 2
        x = [sum((net.e[k] for k in row), np.zeros(toxicity.DIM)) for row in toxicity.buckets(words)]
        hidden = []
        for w, b in zip(net.w, net.b, strict=True):
            values = [[sum(float(x[p + o] @ w[o][:, f]) for o in range(len(w))) + b[f] for p in range(len(x) - len(w) + 1)] for f in range(toxicity.FILTERS)]
            hidden += [max(0.0, max(v)) for v in values]
        seen = toxicity.Numbers()
        at, starts = toxicity.ids_of([text], seen)
        assert abs(net.logits(list(seen), at, starts)[0] - (np.dot(hidden, net.v) + net.c[0])) < 1e-4


def test_best_threshold_equals_trying_all():
    rng = np.random.default_rng(6)
    for _ in range(50):
        bins = np.unique(rng.integers(-50, 50, 12))
        toxic, clean = rng.integers(0, 4, len(bins)), rng.integers(0, 4, len(bins))
        errors = lambda level: sum(t for b, t in zip(bins, toxic, strict=True) if (b + 0.5) / toxicity.BINS < level) + sum(c for b, c in zip(bins, clean, strict=True) if (b + 0.5) / toxicity.BINS >= level)
        cuts = [(b + d) / toxicity.BINS for b in bins for d in (-0.25, 1.25)]
        assert errors(toxicity.best_threshold(bins, toxic, clean)) == min(map(errors, cuts))


def test_network_scores_texts_alone_as_in_a_batch():
    net = toxicity.Network()
    texts = ["", None, "one", "one two", "a b c d e f " * 50, "...", "é è"]
    predictor = language.Predictor({"langs": [], "table": {}, "scores": np.zeros((0, 0))})
    one = lambda some: toxicity.logits_and_languages(net, predictor, some)[0]
    together, alone = one(texts), np.concatenate([one([t]) for t in texts])
    assert np.allclose(together, alone, atol=1e-5)


def test_toxicity_of_awkward_rows(spark, edge_docs, no_docs):
    docs, labels = toxic_rows(spark, 200)
    model = toxicity.fit(docs, labels.union(spark.createDataFrame([(None, 1), (3, None)], labels.schema)), F.lit(True))
    assert toxicity.score(edge_docs, model).filter("score BETWEEN 0 AND 1").count() == edge_docs.count()
    assert toxicity.score(no_docs, model).count() == 0
    assert {r.score for r in toxicity.score(edge_docs, toxicity.fit(docs, labels.limit(0), F.lit(True))).collect()} == {0.0}


def test_thresholds_cover_all_labelled_rows(spark):
    """A language with 1 in 100 labelled rows gets its own threshold, though the sample holds next to none of it."""
    docs, labels = toxic_rows(spark, 3000)
    docs = docs.withColumn("lang", F.when(F.col("doc_id") % 50 < 2, "fr").otherwise("en")).withColumn("text", F.when(F.col("lang") == "fr", F.concat(F.lit("quoi donc "), F.regexp_replace("text", "w", "qu"))).otherwise(F.col("text")))
    model = toxicity.fit(docs, labels, F.lit(True), {1: 60, 0: 120})
    assert set(model["thresholds"]) == {"en", "fr"}
    assert toxicity.score(docs, model).count() == 3000
