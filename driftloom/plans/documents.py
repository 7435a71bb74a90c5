"""Many specification documents at a time: a table with a document per row, checked and read by tasks."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, StringType, StructField, StructType

from driftloom.errors import ConfigurationError
from driftloom.plans.spec import Config


def _config(text: str | None) -> tuple[Config | None, str | None]:
    """The document's configuration, or what is wrong with it."""
    import yaml

    if text is None:
        return None, "there is no document"
    try:
        data = yaml.safe_load(text) if text[:1] != "{" else json.loads(text)
        if not isinstance(data, dict) or not data:
            raise ConfigurationError("the document isn't a mapping, or is empty")
        return Config(data), None
    except (yaml.YAMLError, ValueError, ConfigurationError) as error:
        return None, f"{type(error).__name__}: {error}"


def _with(docs: DataFrame, column: str, names: list[str], kinds: list[DataType], of: Callable[[str | None], tuple]) -> DataFrame:
    """``docs`` and what ``of`` makes of each document."""
    taken = sorted({c.lower() for c in docs.columns} & {n.lower() for n in names})
    if taken:
        raise ValueError(f"the table has columns {taken} already")
    schema = StructType([*docs.schema.fields, *(StructField(n, k) for n, k in zip(names, kinds, strict=True))])
    types = [pa.bool_() if isinstance(k, BooleanType) else pa.string() for k in kinds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [of(text) for text in batch.columns[-1].to_pylist()]
            more = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *more], schema.names)

    return docs.select("*", F.col(column).cast("string").alias("document_")).mapInArrow(run, schema)


def check_documents(docs: DataFrame, column: str) -> DataFrame:
    """``docs`` with valid and error: each row's YAML or JSON document against all rules.

    A null or empty document is invalid; a valid one has a null error.  All rows stay.
    """

    def one(text: str | None) -> tuple[bool, str | None]:
        config, error = _config(text)
        return config is not None, error

    return _with(docs, column, ["valid", "error"], [BooleanType(), StringType()], one)


def read_documents(docs: DataFrame, column: str, paths: dict[str, str]) -> DataFrame:
    """``docs`` with a string column for each of ``paths``: the values at dotted paths, as JSON unless they are strings.

    Null where a document has no such path or isn't valid.
    """

    def one(text: str | None) -> tuple[str | None, ...]:
        config, _ = _config(text)
        values = [None if config is None else config.get(path) for path in paths.values()]
        return tuple(v if v is None or isinstance(v, str) else json.dumps(v) for v in values)

    return _with(docs, column, list(paths), [StringType()] * len(paths), one)
