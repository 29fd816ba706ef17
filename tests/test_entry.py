"""The entry points with and without the optional text operators."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__
from meshwork.plans import queries as graph_queries

TOP = Path(__spark_entry__.__file__).resolve().parent
SAYS = """
import __spark_entry__ as e
print(len(e.queries()), len(e.oracle_sql()), sorted(k for k in e.queries() if k.startswith("op") or k == "pipeline"))
import bench
"""


def said(folder) -> str:
    env = os.environ | {"PYTHONPATH": str(folder), "PYTHONDONTWRITEBYTECODE": "1"}
    return subprocess.run([sys.executable, "-c", SAYS], cwd=folder, env=env, capture_output=True, text=True, check=True).stdout.strip()


def copied(to: Path, *left_out: str) -> Path:
    ignored = shutil.ignore_patterns(".git", "__pycache__", *left_out)
    return Path(shutil.copytree(TOP, to, ignore=ignored))


def test_without_the_text_operators_the_rest_is_whole(tmp_path):
    want = f"{len(graph_queries.QUERIES)} {len(graph_queries.ORACLES)} []"
    assert said(copied(tmp_path / "a", "llm", "corpus_pipeline.py")) == want
    assert said(copied(tmp_path / "b", "llm")) == want


def test_oracles_belong_to_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(graph_queries.QUERIES) <= set(__spark_entry__.queries())
