import os
import pathlib
import shutil
import subprocess
import sys

import pytest

from hornbeam.plans import catalog
from tests.oracle import connect, compare

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, con, name):
    compare(spark, con, catalog.QUERIES[name], catalog.ORACLES[name], SF)


def test_entry_points_hold_without_the_corpus_operators(tmp_path):
    """In a copy of the repository without them, in a process of its own."""
    root = pathlib.Path(__file__).resolve().parent.parent
    shutil.copytree(root, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py"))
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    env = os.environ | {"PYTHONPATH": str(tmp_path / "r")}
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", env=env, capture_output=True, text=True, timeout=120)
    assert said.stdout.split() == [str(len(catalog.QUERIES)), str(len(catalog.ORACLES))], said.stderr


def test_every_query_has_its_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)
