"""Row-level operators on files as they arrive.

The row operators (parsing, features, filters, tiers, actions, row alerts) trigger no Spark
job themselves, so the same functions work on batch and on streaming tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def arriving(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Parquet files under a folder as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def process_arrived(stream: DataFrame, operator: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> None:
    """Applies a row-level operator to all files that arrived since the last run, each exactly once."""
    query = (
        operator(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
