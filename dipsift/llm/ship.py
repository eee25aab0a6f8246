"""Makes this package importable in Python workers of any cluster."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SENT: set[str] = set()
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 1000


def ship(spark: SparkSession) -> None:
    """Send the package's source to the executors once a session, as ``--py-files`` would.

    Rows here are whole texts, so Arrow batches of the session are held to 1,000
    rows: a worker and the JVM beside it each keep one or two at a time."""
    if not 0 < int(spark.conf.get(BATCH, "10000")) <= BATCH_ROWS:
        spark.conf.set(BATCH, str(BATCH_ROWS))
    app = spark.sparkContext.applicationId
    if app in _SENT:
        return
    top = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="spark-")  # the driver's own; Spark copies the file
    target = os.path.join(folder, f"{top.name}.zip")
    with zipfile.ZipFile(target, "w") as out:
        for path in sorted(top.rglob("*.py")):
            out.write(path, path.relative_to(top.parent))
    spark.sparkContext.addPyFile(target)
    _SENT.add(app)
