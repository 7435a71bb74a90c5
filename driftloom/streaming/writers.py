"""File, table and message sinks: one call for a batch or a stream."""

from __future__ import annotations

import re
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import ArrayType, MapType, StructType

from driftloom.sources.shared import shared_path

FORMATS = ("parquet", "json", "csv", "delta", "kafka", "driftloom_records", "memory", "noop")


def for_kafka(envelopes: DataFrame) -> DataFrame:
    """key and value columns, as message sinks of this kind (event hubs too) expect them."""
    return envelopes.select(F.col("partition_key").alias("key"), F.col("data").alias("value"))


def flat_only(df: DataFrame) -> DataFrame:
    nested = [f.name for f in df.schema if isinstance(f.dataType, ArrayType | MapType | StructType)]
    if nested:
        raise ValueError(f"CSV can't hold the nested columns {nested}; write JSON or Parquet, or an envelope")
    return df


def write(
    df: DataFrame,
    fmt: str,
    path: str | None = None,
    *,
    partition_by: tuple[str, ...] = (),
    checkpoint: str | None = None,
    trigger: dict | None = None,
    output_mode: str = "append",
    query_name: str | None = None,
    table: str | None = None,
    **options: object,
) -> StreamingQuery | None:
    """Write a batch, or start a stream and return its query.

    ``options`` are the sink's own, such as maxRecordsPerFile, compression or mergeSchema.
    With ``table`` the rows go to a table of the catalog, at ``path`` where that is given.
    """
    if fmt not in FORMATS:
        raise ValueError(f"unknown sink {fmt!r}; there are {', '.join(FORMATS)}")
    df = flat_only(df) if fmt == "csv" else for_kafka(df) if fmt == "kafka" else df
    writer = df.writeStream if df.isStreaming else df.write
    writer = writer.format(fmt).options(**{k: str(v) for k, v in options.items()})
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    try:
        if not df.isStreaming:
            writer = writer.mode("append" if output_mode == "append" else "overwrite")
            if table:
                (writer.option("path", path) if path else writer).saveAsTable(table)
            else:
                writer.save(path)
            return None
        if checkpoint:
            writer = writer.option("checkpointLocation", checkpoint)
        if query_name:
            writer = writer.queryName(query_name)
        writer = writer.outputMode(output_mode).trigger(**(trigger or {"processingTime": "1 second"}))
        if table:
            return (writer.option("path", path) if path else writer).toTable(table)
        return writer.start(path) if path else writer.start()
    except (PySparkException, Py4JJavaError) as error:
        if fmt in ("delta", "kafka") and re.search("find|ClassNotFound", str(error)):
            raise RuntimeError(f"the {fmt} sink needs its package on Spark's class path") from error
        raise


def read_merged(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Files whose columns have changed over time: all columns, null where a file has none."""
    return spark.read.option("mergeSchema", "true").format(fmt).load(path)


def route(events: DataFrame, key: str, groups: dict[str, tuple[str, ...]], sink: Callable[[DataFrame, str], None], **start: str) -> StreamingQuery:
    """Each group of event types to a sink of its own, from one reading of the stream.

    ``start`` are options of the stream; without ``checkpointLocation`` a fresh folder
    below the shared one is taken.
    """

    def split(batch: DataFrame, _: int) -> None:
        batch.persist()
        try:
            for name, types in groups.items():
                sink(batch.filter(F.col(key).isin(*types)), name)
        finally:
            batch.unpersist()

    start = {"checkpointLocation": shared_path(events.sparkSession, "route")} | start
    writer = events.writeStream.foreachBatch(split)
    for k, v in start.items():
        writer = writer.option(k, v)
    return writer.trigger(availableNow=True).start()
