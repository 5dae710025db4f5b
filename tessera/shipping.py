"""Send this package to the executors, whose Python need not have it installed."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent


#: Rows and bytes of one Arrow batch: texts run to megabytes, so rows alone don't bound it.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def ship(spark: SparkSession) -> None:
    """Bound Arrow batches, and add the package's sources to the session's Python files, once for each Spark context."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    context = spark.sparkContext
    if getattr(context, "_tessera_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(), f"{PACKAGE.name}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, str(p.relative_to(PACKAGE.parent)))
    context.addPyFile(path)
    context._tessera_shipped = True
