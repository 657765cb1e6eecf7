import corpus_pipeline
import pandas as pd

from kerntrail.llm import decontamination, simhash


def test_stages_and_their_columns(spark, data):
    docs, counts = spark.read.parquet(f"{data}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, data).cache()
        assert out.columns == docs.columns, name
        counts.append(out.count())
        if name == "near_duplicates":
            assert counts[-1] == simhash.near_duplicates(docs).select("component_id").distinct().count()
        docs = out
    assert counts[0] >= counts[1] >= counts[2] > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "mixing", "sharding"]


def test_stages_on_awkward_rows(spark, data, edge_docs, edge_rows, no_docs):
    """Null, empty, repeated and very long rows, and extra columns with clashing names, at every stage."""
    texts = [r[1] for r in edge_rows]
    kept = {name: stage(spark, edge_docs, data).collect() for name, stage in corpus_pipeline.STAGES}
    of = lambda name: sorted(str((r.doc_id, r.text)) for r in kept[name])
    every = sorted(str((r[0], r[1])) for r in edge_rows)
    assert of("language") == sorted(str((r[0], r[1])) for r in edge_rows if r[1] and r[1].strip())
    assert of("decontamination") == every and of("sharding") == every
    assert len({r.text for r in kept["near_duplicates"]}) == len(kept["near_duplicates"]) < len(texts)
    assert set(of("mixing")) <= set(every)
    for name, stage in corpus_pipeline.STAGES:
        columns = stage(spark, edge_docs, data).columns
        assert columns[: len(edge_docs.columns)] == edge_docs.columns if name != "sharding" else set(edge_docs.columns) <= set(columns)
        empty = stage(spark, no_docs, data)
        assert empty.count() == 0 and set(edge_docs.columns) <= set(empty.columns), name
        assert all(r.key == "mine key" and r.slot == "mine slot" for r in kept[name]), name


def test_run_equals_the_stages_by_brute_force(spark, data):
    """What run() keeps: texts with letters, one of each class of fingerprints, not contaminated, as often as their source's rate says."""
    docs = pd.read_parquet(f"{data}/documents.parquet")
    rows = [(d, t, s) for d, t, s in zip(docs.doc_id, docs.text, docs.source, strict=True) if t is not None and any(c.isalpha() for c in t)]
    prints = [simhash.fingerprint(t) for _, t, _ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 4:
                root[find(i)] = find(j)
    first = {}
    for i, r in enumerate(rows):
        first[find(i)] = min(first.get(find(i), r), r, key=lambda x: x[0])
    items = pd.read_parquet(f"{data}/benchmark.parquet")
    scanner = decontamination.Scanner([(str(i), t) for i, t in zip(items.item_id, items.text, strict=True)])

    def clean(text):
        words = decontamination.normal_words(text)
        hit = sum(b - a for a, b in decontamination.covered([(a, b) for a, b, _ in scanner.scan(words)]))
        return not (hit and 20 * hit >= len(words))

    left = [r for r in first.values() if clean(r[1])]
    out = corpus_pipeline.run(spark, data).toPandas()
    times = out.groupby("doc_id").size().to_dict()
    sizes = {}
    for d, t, s in left:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    assert set(times) <= {r[0] for r in left}
    want = targets(sizes)
    for d, _, s in left:
        rate = want[s] / sizes[s]
        assert times.get(d, 0) in (int(rate), int(rate) + 1)


def targets(sizes):
    """Targets by levelling again until none is above its limit."""
    order = sorted(sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, open_, rest = {}, set(order), 1.5 * sum(sizes.values())
    while open_:
        level = rest / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in open_}
        for s in over:
            target[s] = 2.0 * sizes[s]
            rest -= target[s]
        open_ -= over
    return target


def test_run_keeps_texts_and_drops_contaminated_ones(spark, data):
    out = corpus_pipeline.run(spark, data).toPandas()
    docs = pd.read_parquet(f"{data}/documents.parquet").set_index("doc_id")
    assert (out.text == docs.loc[out.doc_id, "text"].to_numpy()).all()
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in out.groupby("shard"))
    items = pd.read_parquet(f"{data}/benchmark.parquet")
    scanner = decontamination.Scanner([(str(i), t) for i, t in zip(items.item_id, items.text, strict=True)])
    for text in out.text.unique():
        words = decontamination.normal_words(text)
        n, found = len(words), scanner.scan(words)
        hit = sum(b - a for a, b in decontamination.covered([(a, b) for a, b, _ in found]))
        assert not (hit and 20 * hit >= n)
