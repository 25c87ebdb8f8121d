"""Give the executors this package, wherever the driver was started."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Add the package to the session's Python files, once per Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_callscope_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    # the driver's file server hands the archive out; executors never read this folder
    archive = os.path.join(tempfile.mkdtemp(prefix="callscope-"), "callscope.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(here)))
    sc.addPyFile(archive)
    sc._callscope_shipped = True
