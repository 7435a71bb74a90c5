"""The keyed envelope for message sinks, and its way back."""

from __future__ import annotations

from py4j.protocol import Py4JError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.avro.functions import to_avro
from pyspark.sql.types import StructType

from driftloom.errors import ConfigurationError
from driftloom.plans.spec import Spec


def to_envelope(wide: DataFrame, spec: Spec) -> DataFrame:
    """partition_key and data: all columns of a row as flat JSON, nulls left out.

    A table without any timestamp gets ``event_timestamp``, now.  The key stays in the
    payload too.  With ``serialization_format: avro`` the data is binary Avro, where
    Spark's Avro package is there.
    """
    key = spec.partition_key
    if not key:
        raise ValueError("sink_config.partition_key_field is required for envelopes; name a visible column")
    stamped = "event_timestamp" in wide.columns or any(f.type == "timestamp" and n in wide.columns for n, f in spec.common)
    if not stamped:
        wide = wide.withColumn("event_timestamp", F.current_timestamp())
    if key not in wide.columns:
        raise ValueError(f"sink_config.partition_key_field: there is no column {key!r}")
    if spec.serialization == "avro":
        return avro_envelope(wide, key)
    return envelope(wide, key)


def avro_envelope(wide: DataFrame, key: str) -> DataFrame:
    """Any table as an envelope of binary Avro, by the schema that follows from its columns."""
    try:
        payload = to_avro(F.struct(*(f"`{c}`" for c in wide.columns)))
        return wide.select(F.col(f"`{key}`").cast("string").alias("partition_key"), payload.alias("data"))
    except (AnalysisException, TypeError, Py4JError) as error:
        raise ConfigurationError("serialization_format: 'avro' needs Spark's Avro package on the class path") from error


def envelope(wide: DataFrame, key: str, columns: tuple[str, ...] | None = None) -> DataFrame:
    """Any table as an envelope."""
    quoted = [f"`{c}`" for c in columns or wide.columns]
    payload = F.to_json(F.struct(*quoted), {"ignoreNullFields": "true"})
    return wide.select(F.col(f"`{key}`").cast("string").alias("partition_key"), payload.alias("data"))


def from_envelope(envelopes: DataFrame, schema: StructType | str) -> DataFrame:
    """The wide table again, by its schema; a payload that isn't JSON gives nulls."""
    return envelopes.select(F.from_json(F.col("data").cast("string"), schema).alias("p")).select("p.*")


def extract(envelopes: DataFrame, fields: dict[str, str], data: str = "data", keep: tuple[str, ...] = ()) -> DataFrame:
    """Single fields of a payload by name: {column: type}; it is parsed once."""
    kind = ", ".join(f"`{n}` string" for n in fields)
    said = envelopes.select(*keep, F.from_json(F.col(data).cast("string"), kind).alias("said"))
    return said.select(*keep, *(F.col("said")[n].cast(t).alias(n) for n, t in fields.items()))
