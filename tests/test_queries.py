"""Every registered query against its SQL on the smallest tables; the others must run."""

import pytest

from oracle import connect, same
from voxelake.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("key", sorted(SQL))
def test_equals_sql(key, spark, sf_dir, con):
    same(QUERIES[key](spark, sf_dir).toPandas(), con.sql(SQL[key]).df())


@pytest.mark.parametrize("key", sorted(set(QUERIES) - set(SQL)))
def test_runs(key, spark, sf_dir):
    assert QUERIES[key](spark, sf_dir).columns


def test_entry(spark):
    import __spark_entry__ as e

    got = {r.tissue: r.n for r in e.entry(spark).collect()}
    assert len(got) == 7 and sum(got.values()) > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_without_the_training_part(tmp_path):
    """The guard: with llm and the pipeline gone, the rest still imports."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    repo = Path(__file__).resolve().parent.parent
    shutil.copytree(repo / "voxelake", tmp_path / "voxelake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(repo / "__spark_entry__.py", tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()))"], cwd=tmp_path, capture_output=True, text=True)
    assert int(out.stdout) == len(QUERIES), out.stderr


