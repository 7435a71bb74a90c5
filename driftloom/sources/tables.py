"""Parquet tables, as a batch or as a stream of their files, and replays of envelopes."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table; only ``columns`` where given.  Times are taken as UTC instants."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    naive = [c for c, kind in df.dtypes if kind == "timestamp_ntz"]
    df = df.withColumns({c: F.col(c).cast("timestamp") for c in naive})
    return df.select(*columns) if columns else df


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The same as a stream of the table's files."""
    path = f"{sf_dir}/{name}.parquet"
    kind = spark.read.parquet(path)
    stream = spark.readStream.schema(kind.schema).option("pathGlobFilter", "*.parquet")
    # a table is one file or a folder of files; the source reads folders
    files = stream.parquet(path) if _is_folder(spark, path) else stream.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    naive = [c for c, t in kind.dtypes if t == "timestamp_ntz"]
    return files.withColumns({c: F.col(c).cast("timestamp") for c in naive})


def _is_folder(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()


def envelope_stream(
    spark: SparkSession, path: str, fmt: str = "parquet", start: str = "earliest", files_per_batch: int | None = None
) -> DataFrame:
    """A replay of envelopes that were written to files.

    ``start`` is "earliest", "latest" (only files written from now on), or a time: files
    written from then on.  ``files_per_batch`` bounds a micro-batch.
    """
    reader = spark.readStream.schema("partition_key string, data string").format(fmt)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    stream = reader.load(path)
    if start == "earliest":
        return stream
    since = F.lit(datetime.now(timezone.utc)) if start == "latest" else F.lit(start).cast("timestamp")
    return stream.filter(F.col("_metadata.file_modification_time") >= since)
