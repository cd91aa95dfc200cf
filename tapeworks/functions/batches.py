"""How much a vectorised step takes at once."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Bytes of an Arrow batch, the same that the corpus operators set, so queries that wait to be run see no change.
BATCH_BYTES = 4 << 20


def bounded_batches() -> None:
    """Limit Arrow batches by bytes: texts and pages are long, and batches of so many rows would not fit a worker."""
    SparkSession.active().conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
