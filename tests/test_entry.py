"""The driver contract."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
def test_entry_returns_pages(spark):
    df = entry.entry(spark)
    assert df.columns == ["query_id", "chunk_id", "final_rank", "semantic", "conflicts", "keyword", "vector", "doc_hits"]
    rows = df.collect()
    assert rows and max(r["conflicts"] for r in rows) > 0 and min(r["final_rank"] for r in rows) == 1


def test_entry_without_the_training_data_subpackage(tmp_path):
    """The entry and its core queries stay where that subpackage, its tests and the pipeline are deleted."""
    root = os.path.dirname(os.path.abspath(entry.__file__))
    copy = tmp_path / "copy"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'r02_bm25' in q and not [n for n in q if n.startswith('op') or n == 'pipeline'] and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env={**os.environ, "PYTHONPATH": str(copy)})
    os.remove(copy / "corpus_pipeline.py")
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env={**os.environ, "PYTHONPATH": str(copy)})
