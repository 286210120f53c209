"""Sending this package to the executors, for sessions that weren't started with it."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()
#: Rows of an Arrow batch: they hold whole texts and images, in each worker and twice on the way to it.
BATCH_ROWS = 512


def prepare(spark: SparkSession) -> None:
    """What all plans of this package ask of a session, the same for each, so that no query depends on what ran before it."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def ship(spark: SparkSession) -> None:
    """Prepare the session, and add the package to the Python path of its workers, once for each application."""
    prepare(spark)
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).parents[1]
    target = Path(tempfile.mkdtemp(prefix="sievewright-")) / f"{root.name}.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for f in sorted(root.rglob("*.py")):
            out.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(target))
    _SHIPPED.add(sc.applicationId)
