"""Helpers that the corpus operators share: tables, shared folders, cut lineage."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from driftloom.sources.shared import shared_path


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table of the corpus; only ``columns`` where they are given."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


#: Bytes of an Arrow batch that a Python worker gets, and Spark's own default.
BATCH_BYTES = 8 << 20
_BATCH_SETTING, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def bound_batches(spark: SparkSession) -> None:
    """Texts may be long: unless the session has a setting of its own, batches for Python hold ``BATCH_BYTES``.

    An executor holds a batch of each task several times, in the JVM and in Python.
    """
    if spark.conf.get(_BATCH_SETTING, _BATCH_DEFAULT) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH_SETTING, f"{BATCH_BYTES}b")


#: Whether shuffle files go when the query that made them has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _write(df: DataFrame, path: str, **options: object) -> DataFrame:
    spark = df.sparkSession
    bound_batches(spark)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        writer = df.write.option("compression", "zstd")
        for key, value in options.items():
            writer = writer.option(key.replace("__", "."), str(value))
        writer.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def stored(df: DataFrame, name: str, **options: object) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back.

    This cuts the lineage in a way that outlives executors.  The step's shuffle files go
    when it has been written.
    """
    return _write(df, shared_path(df.sparkSession, name), **options)


class Steps:
    """The tables that one run of an operator writes, in a folder of its own.

    ``drop`` removes a table as soon as no later step reads it.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.folder, self.written = spark, shared_path(spark, name), 0

    def store(self, df: DataFrame, name: str, **options: object) -> DataFrame:
        self.written += 1
        return _write(df, f"{self.folder}/{self.written}-{name}", **options)

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark.sparkContext._jvm
        for folder in {os.path.dirname(f) for t in tables for f in t.inputFiles()}:
            at = jvm.org.apache.hadoop.fs.Path(folder)
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def wider(schema: StructType, **kinds: str | DataType) -> StructType:
    """A schema with further columns."""
    out = StructType(list(schema.fields))
    for name, kind in kinds.items():
        out = out.add(name, kind)
    return out


def unused(name: str, taken: list[str]) -> str:
    """A column name that isn't taken yet, upper and lower case alike."""
    names = {t.lower() for t in taken}
    while name.lower() in names:
        name += "_"
    return name


def quoted(names: list[str]) -> list[str]:
    """Column names that may hold dots or blanks."""
    return [f"`{n.replace('`', '``')}`" for n in names]


def map_rows(docs: DataFrame, run: Callable, schema: StructType) -> DataFrame:
    """``mapInArrow`` for columns of any name, dots and blanks included."""
    bound_batches(docs.sparkSession)
    names = docs.columns
    plain = StructType([StructField(f"c{k}", f.dataType, True) for k, f in enumerate(schema.fields)])

    def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in run(b.rename_columns(names) for b in batches):
            yield out.rename_columns(plain.names)

    return docs.toDF(*(f"c{k}" for k in range(len(names)))).mapInArrow(renamed, plain).toDF(*schema.names)


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)


def whole_text(column: str = "text") -> Column:
    """A null text counts as an empty one."""
    return F.coalesce(F.col(column), F.lit(""))


def limit_threads() -> None:
    """Python workers share an executor: keep native libraries to one thread each."""
    for name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "RAYON_NUM_THREADS"):
        os.environ.setdefault(name, "1")
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
