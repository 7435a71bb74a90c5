"""Sources of unique row ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def batch_rows(spark: SparkSession, rows: int, partitions: int) -> DataFrame:
    """Ids 0 to ``rows`` - 1."""
    return spark.range(0, rows, 1, partitions)


def stream_rows(spark: SparkSession, rows_per_second: int, partitions: int | None = None, ramp_up: str | None = None) -> DataFrame:
    """A stream of ids from 0 on; ``ramp_up`` is the time to reach the full rate."""
    source = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second)
    if partitions:
        source = source.option("numPartitions", partitions)
    if ramp_up:
        source = source.option("rampUpTime", ramp_up)
    return source.load().select(F.col("value").alias("id"))


def microbatch_rows(spark: SparkSession, rows_per_batch: int, partitions: int = 1) -> DataFrame:
    """A stream with a fixed number of ids in each micro-batch, for tests and replays."""
    source = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", rows_per_batch)
    return source.option("numPartitions", partitions).load().select(F.col("value").alias("id"), "timestamp")
