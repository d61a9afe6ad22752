"""Makes the package importable in Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
_sent: set[str] = set()


def ensure_importable(spark: SparkSession) -> None:
    """Sends the package to the executors once per application, unless the environment already names its folder.

    Workers inherit ``PYTHONPATH`` and start in the driver's folder on one
    machine; anywhere else they have what Spark sends them.
    """
    places = [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()]
    app = spark.sparkContext.applicationId
    if app in _sent or any(p and Path(p).resolve() == ROOT for p in places):
        return
    archive = Path(tempfile.mkdtemp()) / "textmill.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted((ROOT / "textmill").rglob("*.py")):
            z.write(f, f.relative_to(ROOT))
    spark.sparkContext.addPyFile(str(archive))
    _sent.add(app)
