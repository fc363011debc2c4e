"""Makes this package importable in Python workers that do not have it on their path."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors once for each application, unless they find it anyway."""
    app = spark.sparkContext.applicationId
    if app in _sent:
        return
    _sent.add(app)
    found = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT in found or (spark.sparkContext.master.startswith("local[") and os.getcwd() == ROOT):
        return
    to = tempfile.mkdtemp(prefix="marginalia-")
    spark.sparkContext.addPyFile(shutil.make_archive(f"{to}/marginalia", "zip", ROOT, "marginalia"))
