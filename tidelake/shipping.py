"""Gives the package to the Python workers of a session."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Adds this package to what Spark hands to its executors, once for each application.

    Where it is on their path already (``--py-files``, PYTHONPATH), this changes nothing."""
    context = spark.sparkContext
    if getattr(context, "_tidelake_shipped", None):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    context.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp(prefix='tidelake-')}/tidelake", "zip", root, "tidelake"))
    context._tidelake_shipped = True
