"""Makes the package importable on Python workers, wherever the driver was started."""

from __future__ import annotations

import atexit
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parent


def package(spark: SparkSession) -> None:
    """Sends the package's sources to the executors, once per Spark context; Spark serves the archive from the driver."""
    sc = spark.sparkContext
    if getattr(sc, "_terracell_shipped", False):
        return
    handle, path = tempfile.mkstemp(prefix="terracell-", suffix=".zip")
    os.close(handle)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(_ROOT.rglob("*.py")):
            z.write(f, f"{_ROOT.name}/{f.relative_to(_ROOT).as_posix()}")
    sc.addPyFile(path)
    sc._terracell_shipped = True
    atexit.register(lambda: Path(path).unlink(missing_ok=True))
