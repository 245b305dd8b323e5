"""Makes this package importable on every executor."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Rows and bytes of an Arrow batch, where the session has Spark's defaults: texts are long, and a worker
#: holds several times a batch.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "16m"}
DEFAULTS = {"10000", "9223372036854775807b", "9223372036854775807", "2147483647", "-1", "67108864b", "64m"}


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once for each application."""
    for key, value in BATCHES.items():
        if spark.conf.get(key, None) in DEFAULTS:
            spark.conf.set(key, value)
    context = spark.sparkContext
    if getattr(context, "_logloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="logloom-"), "logloom.zip")
    with zipfile.ZipFile(target, "w") as out:
        for p in sorted(root.rglob("*.py")):
            out.write(p, p.relative_to(root.parent))
    context.addPyFile(target)
    context._logloom_shipped = True
