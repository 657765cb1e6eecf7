import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng, n, stems="al be co du en fi go ha is jo ka lo".split()):
    return " ".join("".join(rng.choice(stems) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="session")
def edge_rows():
    """Null ids, texts, languages and sources; empty, blank and very long texts; repeated rows; copies; other scripts."""
    rng = random.Random(5)
    copy = sentence(rng, 80)
    rows = [
        (1, None, "en", "a", None),
        (2, "", "en", None, 0),
        (3, " \t\n ", None, "a", 3),
        (4, copy, "en", "b", 1),
        (5, copy, "en", "b", 1),
        (5, copy, "en", "b", 1),
        (None, copy + " end", "fr", None, 2),
        (None, None, None, None, None),
        (6, sentence(rng, 30_000), "fr", "c", 9),
        (7, "日本語のテキスト ！ Éà ß 1234 ...", "de", "c", 9),
        (8, "x" * 5_000, "en", "c", 9),
        (9, "be be " * 400, "en", "c", 9),
    ]
    return rows + [(20 + k, sentence(rng, rng.randint(1, 300)), rng.choice(["en", "fr"]), rng.choice(["a", "b", None]), k) for k in range(60)]


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows, tmp_path_factory):
    """As a table with extra columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    path = str(tmp_path_factory.mktemp("edge") / "documents.parquet")
    extra = ["size", "shard", "slot", "score", "target", "copies", "fp", "row_key", "block", "component_id", "key"]
    spark.createDataFrame(edge_rows, SCHEMA).withColumns({c: F.lit(f"mine {c}") for c in extra}).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.filter("doc_id < -1")
