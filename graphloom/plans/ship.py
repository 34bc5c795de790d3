"""Sends this package to executors that don't have it on their path."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[2]


def ship(spark: SparkSession) -> None:
    """Once a context; nothing to do where PYTHONPATH already names the folder."""
    sc = spark.sparkContext
    if getattr(sc, "_graphloom_shipped", False) or str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    out = tempfile.mkdtemp(prefix="graphloom-")
    sc.addPyFile(shutil.make_archive(f"{out}/graphloom", "zip", ROOT, "graphloom"))
    sc._graphloom_shipped = True
