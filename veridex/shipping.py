"""Giving Python workers this package, whatever their path is."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once for each application; Spark's file server hands the archive to the executors."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        root = Path(__file__).resolve().parent
        with tempfile.TemporaryDirectory() as own:
            (tree := Path(own, "tree")).mkdir()
            shutil.copytree(root, tree / root.name, ignore=shutil.ignore_patterns("__pycache__"))
            served = tempfile.mkdtemp(prefix="veridex_src_")
            # the driver's file server reads it for as long as the application runs
            atexit.register(shutil.rmtree, served, ignore_errors=True)
            packed = shutil.make_archive(str(Path(served, "veridex_src")), "zip", tree)
        sc.addPyFile(packed)
        _shipped.add(sc.applicationId)
