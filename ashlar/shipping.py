"""The package's own modules for Python workers, wherever they run."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives the workers of this application the package, once: Spark's own file server deals it out.

    Jobs then don't depend on what a worker's folder or PYTHONPATH holds.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parent
    path = f"{tempfile.mkdtemp(prefix='ashlar-')}/ashlar_modules.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, str(p.relative_to(top.parent)))
    context.addPyFile(path)
    _shipped.add(context.applicationId)
