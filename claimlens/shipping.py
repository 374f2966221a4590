"""Brings the package to the Python workers, wherever the driver was started."""

from __future__ import annotations

import shutil
import tempfile
from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from claimlens.registry import Query

ROOT = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Adds the package to the session's Python files, once for each context."""
    context = spark.sparkContext
    if getattr(context, "claimlens_shipped", False):
        return
    made = shutil.make_archive(str(Path(tempfile.mkdtemp()) / "claimlens"), "zip", ROOT.parent, ROOT.name)
    context.addPyFile(made)
    context.claimlens_shipped = True


def shipped(query: Query) -> Query:
    """``query`` that ships the package before it plans."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run
