"""Makes this package importable in the Python workers of a session."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the executors, once per application, unless their PYTHONPATH has it."""
    context = spark.sparkContext
    known = [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if os.path.realpath(ROOT) in known or context.applicationId in _shipped:
        return spark
    target = Path(tempfile.mkdtemp(prefix="tessera-code-"), "tessera.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted((ROOT / "tessera").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)
    return spark
