"""Gets the package to the executors where they can't import it from their own path."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent
_shipped: set[str] = set()


def importable_by_workers() -> bool:
    """Workers inherit the driver's PYTHONPATH and, on one machine, its working folder."""
    paths = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    here = ROOT.parent
    return any(Path(p).resolve() == here for p in [*paths, os.getcwd()]) or "site-packages" in here.parts


def ship(spark: SparkSession) -> None:
    """Send the package as a zip through Spark, once for each application."""
    context = spark.sparkContext
    if importable_by_workers() or context.applicationId in _shipped:
        return
    target = Path(tempfile.mkdtemp(prefix="lucerna-")) / "lucerna.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(ROOT.rglob("*.py")):
            z.write(p, p.relative_to(ROOT.parent))
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)
