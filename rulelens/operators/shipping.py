"""This package's code for Python workers, where tasks run classes of it or of its users' models."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send the package to the workers, once for each Spark application."""
    sc = spark.sparkContext
    if getattr(sc, "_rulelens_shipped", False):
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="rulelens-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = os.path.join(folder, "rulelens_code.zip")
    with zipfile.ZipFile(target, "w") as z:
        for at, _, names in os.walk(package):
            for n in names:
                if n.endswith(".py"):
                    z.write(os.path.join(at, n), os.path.relpath(os.path.join(at, n), os.path.dirname(package)))
    sc.addPyFile(target)
    sc._rulelens_shipped = True
