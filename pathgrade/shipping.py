"""Let executors import this package."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """The package's modules go to the executors as a zip, once a session, unless PYTHONPATH has them."""
    root = Path(__file__).resolve().parents[1]
    app = spark.sparkContext.applicationId
    if app in _sent or str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    _sent[app] = tempfile.mkdtemp(prefix="pathgrade-")
    atexit.register(shutil.rmtree, _sent[app], ignore_errors=True)
    with zipfile.ZipFile(f"{_sent[app]}/pathgrade.zip", "w") as z:
        for p in (root / "pathgrade").rglob("*.py"):
            z.write(p, p.relative_to(root))
    spark.sparkContext.addPyFile(f"{_sent[app]}/pathgrade.zip")
