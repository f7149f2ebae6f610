"""Makes the package importable in Spark's Python workers wherever the driver was started."""

from __future__ import annotations

import functools
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package's sources to the application's Python files, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    target = tempfile.mkdtemp(prefix="factloom-")
    shutil.copytree(package, f"{target}/src/{package.name}", ignore=shutil.ignore_patterns("__pycache__"))
    spark.sparkContext.addPyFile(shutil.make_archive(f"{target}/{package.name}", "zip", f"{target}/src"))
    _shipped.add(app)


def shipped(query):
    """The query, with the package shipped before it runs."""

    @functools.wraps(query)
    def run(spark, sf_dir):
        ship(spark)
        return query(spark, sf_dir)

    return run
