"""Makes this package importable on the executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: list[str] = []


def ship(spark: SparkSession) -> None:
    """Ships the package as a zip, once for each application."""
    sc = spark.sparkContext
    if _shipped == [sc.applicationId]:
        return
    package = Path(__file__).resolve().parent
    at = tempfile.mkdtemp(prefix="plinth-code-")
    atexit.register(shutil.rmtree, at, True)
    with zipfile.ZipFile(f"{at}/plinth.zip", "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(f"{at}/plinth.zip")
    _shipped[:] = [sc.applicationId]
