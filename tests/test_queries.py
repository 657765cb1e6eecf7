"""Every query of the library against its SQL on the smallest tables; those without SQL must give rows."""

import pytest
from tablediff import rows_of

from kerntrail.plans import kernels, molecules, records, runs, scalars, structures  # noqa: F401
from kerntrail.plans.registry import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, data, duck, name):
    found, want = QUERIES[name](spark, data).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(found.columns) == sorted(want.columns)
    assert rows_of(found) == rows_of(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_corpus_operators(tmp_path):
    """The rest imports and registers its queries when their folders are gone, compiled leftovers or not."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "kerntrail", tmp_path / "kerntrail", ignore=shutil.ignore_patterns("llm"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(n.startswith('op') and n[2].isdigit() for n in e.queries()))"
    for leftovers in (False, True):
        if leftovers:
            (tmp_path / "kerntrail" / "llm" / "__pycache__").mkdir(parents=True)
        said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, check=True).stdout.split()
        assert said == [str(len(QUERIES)), str(len(SQL)), "False"]


def test_the_benchmark_names_registered_queries():
    import __spark_entry__ as entry
    import bench

    known = {n for n in bench.HEADLINE if not (n == "pipeline" or n.startswith("op") and n[2].isdigit())}
    assert known and known <= set(entry.queries())
