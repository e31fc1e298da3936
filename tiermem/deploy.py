"""Brings the package to executors, whose Python workers share no working folder with the driver."""

from __future__ import annotations

import functools
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_DONE: set[str] = set()


def ship(spark: SparkSession, root: Path | None = None) -> None:
    """Add the package's sources to the session's files, once for each application. The zip is a file of the driver's, which Spark itself sends out."""
    app = spark.sparkContext.applicationId
    if app in _DONE:
        return
    root = root or Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp()) / "tiermem.zip"
    with zipfile.ZipFile(path, "w") as out:
        for p in [*sorted((root / "tiermem").rglob("*.py")), *root.glob("corpus_pipeline.py")]:
            out.write(p, p.relative_to(root))
    spark.sparkContext.addPyFile(str(path))
    _DONE.add(app)


def shipped(query: Callable[[SparkSession, str], DataFrame], root: Path) -> Callable[[SparkSession, str], DataFrame]:
    """The query, run in a session that has the package."""

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark, root)
        return query(spark, sf_dir)

    return run
