"""Makes this package importable on the executors, wherever the driver was started."""

from __future__ import annotations

import tempfile
import zipfile
from functools import wraps
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
#: Bytes of a batch that Spark hands to a worker, where the session has Spark's own 64 MB; both sides hold whole batches.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 16 << 20


def ship(spark: SparkSession | None = None) -> None:
    """Send the package's sources to the executors, once for each application; by default that of the active session."""
    spark = spark or SparkSession.getActiveSession()
    if spark is None or not hasattr(spark, "_jsc"):
        return
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    if not root.is_dir():  # it came from an archive that was sent before
        return
    path = Path(tempfile.mkdtemp(prefix="tessera-")) / "tessera.zip"
    with zipfile.ZipFile(path, "w") as z:
        for source in sorted(root.rglob("*.py")):
            z.write(source, f"tessera/{source.relative_to(root)}")
    context.addPyFile(str(path))
    _shipped.add(context.applicationId)


def bound_batches(spark: SparkSession) -> None:
    if spark.conf.get(BATCH_SETTING).rstrip("b") == str(64 << 20):
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def shipped(query):
    """The function (spark, ...) with the package sent first and batches bounded."""

    @wraps(query)
    def run(spark: SparkSession, *rest):
        ship(spark)
        bound_batches(spark)
        return query(spark, *rest)

    return run
