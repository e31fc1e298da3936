"""The entry module away from the repository's folder, without optional parts, and on a cluster without a shared folder."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from tiermem.sources import staging

ROOT = Path(__file__).resolve().parents[1]
CHILD = """
import sys
{before}
sys.path.insert(0, {root!r})
import __spark_entry__ as e
{after}
"""


def _python(code, cwd):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYSPARK_PYTHON": sys.executable}
    done = subprocess.run([sys.executable, "-c", code], cwd=cwd, env=env, capture_output=True, text=True, timeout=240)
    assert not done.returncode, done.stderr[-3000:]
    return done.stdout


def test_workers_find_the_package_from_another_folder(tmp_path):
    run = """
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
print("rows", e.queries()["vec_codec"](spark, "/root/testdata/sf0.001").count(), e.queries()["mem_segment"](spark, "/root/testdata/sf0.001").count())
"""
    out = _python(CHILD.format(before="", root=str(ROOT), after=run), tmp_path)
    n, m = out.split("rows ")[1].split()[:2]
    assert int(n) > 0 and int(m) > 0


def test_missing_packages_only_remove_the_corpus_queries(tmp_path):
    block = "sys.modules['ahocorasick'] = None"
    names = "print(sorted(n for n in e.queries() if n.startswith('op') or n == 'pipeline'), len(e.queries()) > 60, set(e.oracle_sql()) <= set(e.queries()))"
    assert _python(CHILD.format(before=block, root=str(ROOT), after=names), tmp_path).strip().endswith("[] True True")


def test_without_the_corpus_part(tmp_path):
    """A copy without the corpus folders and the pipeline still has every other query, and its tests are found."""
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py"))
    out = _python(CHILD.format(before="", root=str(copy), after="print([n for n in e.queries() if n.startswith('op') or n == 'pipeline'], len(e.queries()) > 60)"), tmp_path)
    assert out.strip().endswith("[] True")
    found = subprocess.run([sys.executable, "-m", "pytest", "--collect-only", "-q", "tests"], cwd=copy, capture_output=True, text=True, timeout=120)
    assert not found.returncode, found.stdout[-2000:]


def test_no_private_folder_on_a_cluster():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        staging.shared_folder(Session())
