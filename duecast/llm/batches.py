"""Arrow batch limits for one written step, put back afterwards."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

_KEYS = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")


@contextmanager
def arrow_batches(spark: SparkSession, rows: int, size: str) -> Iterator[None]:
    """Limits rows and bytes of the batches that Python workers get, for what runs inside; the session's own values return."""
    before = [spark.conf.get(k, None) for k in _KEYS]
    try:
        for key, value in zip(_KEYS, (str(rows), size), strict=True):
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in zip(_KEYS, before, strict=True):
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)
