"""The package on the Python workers of executors that don't have it."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send this package along with the application's tasks; once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_tidewell_shipped", False):
        return
    top = Path(__file__).resolve().parent.parent
    path = Path(tempfile.mkdtemp(prefix="tidewell-")) / "tidewell_package.zip"
    atexit.register(shutil.rmtree, path.parent, True)  # the driver serves the file for as long as it lives
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    sc.addPyFile(str(path))
    sc._tidewell_shipped = True
