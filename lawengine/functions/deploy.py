"""Make this package importable where Python workers can't find it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def importable(spark: SparkSession) -> None:
    """Send the package to Python workers that can't find it by PYTHONPATH; once for each application."""
    root = Path(__file__).resolve().parents[2]
    app = spark.sparkContext.applicationId
    if app in _SENT or str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    _SENT.add(app)
    to = Path(tempfile.mkdtemp(prefix="lawengine-")) / "lawengine.zip"
    with zipfile.ZipFile(to, "w") as z:
        for f in (root / "lawengine").rglob("*.py"):
            z.write(f, f.relative_to(root))
    spark.sparkContext.addPyFile(str(to))
