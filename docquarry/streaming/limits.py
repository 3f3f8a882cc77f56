"""Rate limits over a stream of requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.checks import limited_minutes


def request_stream(spark: SparkSession, folder: str, like: DataFrame) -> DataFrame:
    return spark.readStream.schema(like.schema).parquet(folder)


def limited(stream: DataFrame, limit: int = 5, lateness: str = "5 minutes") -> DataFrame:
    """Minutes above the limit, each once it can no longer change; state is dropped behind the watermark."""
    return limited_minutes(stream.withWatermark("ts", lateness), limit)
