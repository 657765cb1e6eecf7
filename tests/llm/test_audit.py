"""The filter audit against a plain simulation of every order."""

import re
from itertools import permutations

from kerntrail.llm.audit import audit

LABELS = [(4, 1, 0), (5, 0, 1), (5, 1, 0), (6, 1, 1), (20, 1, 0), (21, None, 1), (None, 1, 1), (999, 1, 1)] + [(30 + k, k % 2, k % 3 == 0) for k in range(20)]
LABEL_SCHEMA = "doc_id long, quality int, toxic int, text string, part string"


def labels_of(spark):
    return spark.createDataFrame([(i, q, None if t is None else int(t), "x", "y") for i, q, t in LABELS], LABEL_SCHEMA)


def failures(rows):
    out = []
    for doc_id, text, *_ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        twin = doc_id is not None and any(i is not None and i < doc_id and (t or "") == text for i, t, *_ in rows)
        own = [len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), bool(re.search(r"[#$%&*|]", text)), twin]
        out.append({f for f, bad in zip("ABCDE", own, strict=True) if bad})
    return out


def simulated(rows, labels):
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    fails, out = failures(rows), {}
    for part in {r[2] or "" for r in rows}:
        mine = [k for k, r in enumerate(rows) if (r[2] or "") == part]
        removed_by = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            alive = list(mine)
            for step, f in enumerate(order, 1):
                gone = [k for k in alive if f in fails[k]]
                alive = [k for k in alive if f not in fails[k]]
                removed_by[f] += len(gone)
                failing = [k for k in mine if f in fails[k]]
                lost = [sum(rows[k][0] in s for k in gone) for s in (good, toxic)]
                out[part, order, step] = [len(alive), len(gone), len(failing) - len(gone), sum(fails[k] == {f} for k in failing), *lost]
        for order in map("".join, permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                out[part, order, step].append(removed_by[f])
    return out


def found(df):
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in df.collect()}


def test_equals_a_simulation(spark, edge_rows, edge_docs):
    got = found(audit(edge_docs, labels_of(spark)))
    assert len(got) % 600 == 0
    assert got == simulated(edge_rows, LABELS)


def test_every_filter_and_a_large_group_of_copies(spark):
    long = " ".join(f"w{k}" for k in range(150))
    rows = [(k, long, "en" if k % 3 else "fr") for k in range(400)] + [(k, long, "en") for k in (0, 0, 7)]
    rows += [(1000, "ONLY CAPITALS HERE", "de"), (1001, long + " #", "de"), (1002, "a b " * 80, "de"), (1003, long.upper(), "de"), (1004, "X | " + "é ß " * 90_000, "de"), (1005, None, "de"), (999, "", "de")]
    rows += [(None, long, "de"), (None, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert found(audit(docs, labels_of(spark))) == simulated(rows, LABELS)


def test_without_rows(spark, no_docs):
    assert audit(no_docs, labels_of(spark)).count() == 0


def test_without_labels(spark, edge_docs):
    assert audit(edge_docs, labels_of(spark).filter("doc_id < -1")).filter("good_lost > 0 or toxic_lost > 0").count() == 0
