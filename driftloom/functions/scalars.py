"""Values of scalar fields as expressions over draws."""

from __future__ import annotations

from datetime import UTC, date, datetime
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftloom.functions.draws import Draws, pick
from driftloom.functions.text import provide
from driftloom.plans.spec import DEFAULT_DAYS, DEFAULT_RANGES, Field

_SQL_TYPES = {
    "uuid": "string", "string": "string", "int": "int", "long": "bigint", "short": "smallint",
    "byte": "tinyint", "float": "float", "double": "double", "boolean": "boolean",
    "timestamp": "timestamp", "date": "date", "binary": "binary",
}


def sql_type(field: Field) -> str:
    """The field's type in Spark SQL."""
    if field.type == "decimal":
        return f"decimal({field.precision},{field.scale})"
    if field.type == "array":
        return f"array<{sql_type(field.item)}>"
    if field.type == "map":
        return f"map<{sql_type(Field(field.key_type))},{sql_type(Field(field.value_type))}>"
    if field.type == "struct":
        return "struct<" + ",".join(f"`{n}`:{sql_type(f)}" for n, f in field.fields) + ">"
    return _SQL_TYPES[field.type]


def literal(value: Any, kind: str) -> Column:
    """A typed literal; no SQL text, so nothing needs quoting."""
    if value is not None and kind == "string" and not isinstance(value, str):
        value = str(value).lower() if isinstance(value, bool) else str(value)
    if isinstance(value, datetime | date):
        value = str(value)
    return F.lit(value).cast(kind)


def epoch_seconds(text: str) -> int:
    """Seconds since 1970 of a date or time in UTC, or in its own zone."""
    at = datetime.fromisoformat(text.strip().replace("Z", "+00:00"))
    return int((at if at.tzinfo else at.replace(tzinfo=UTC)).timestamp())


def _dashed(digits: Column) -> Column:
    parts = [F.substring(digits, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat_ws("-", *parts)


def _uuid(draws: Draws, path: str) -> Column:
    digits = draws.digest(path)
    if draws.mode == "portable":
        return _dashed(digits)
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(digits, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return _dashed(F.concat(F.substring(digits, 1, 12), F.lit("4"), F.substring(digits, 14, 3), variant, F.substring(digits, 18, 15)))


def _number(field: Field, draws: Draws, path: str) -> Column:
    low, high = field.range or DEFAULT_RANGES[field.type]
    u = draws.uniform(path)
    if field.type in ("float", "double", "decimal"):
        return (u * F.lit(float(high) - float(low)) + F.lit(float(low))).cast(sql_type(field))
    if field.inclusive:
        whole = F.floor(u * F.lit(float(high - low + 1)))
        return (whole.cast("decimal(20,0)") + F.lit(low).cast("decimal(20,0)")).cast(sql_type(field))
    # towards zero: the upper end isn't drawn, and 0 has twice its share in a range across it
    return (u * F.lit(float(high - low)) + F.lit(float(low))).cast(sql_type(field))


def _moment(field: Field, draws: Draws, path: str) -> Column:
    if field.begin is None or field.end is None:
        return F.current_timestamp()
    low, high = epoch_seconds(field.begin), epoch_seconds(field.end)
    seconds = F.floor(draws.uniform(path) * F.lit(float(high - low))) + F.lit(low)
    return F.timestamp_seconds(seconds)


def _day(field: Field, draws: Draws, path: str) -> Column:
    low = date.fromisoformat((field.begin or DEFAULT_DAYS[0])[:10])
    high = date.fromisoformat((field.end or DEFAULT_DAYS[1])[:10])
    days = F.floor(draws.uniform(path) * F.lit(float((high - low).days))).cast("int")
    return F.date_add(F.lit(low), days)


def scalar(field: Field, draws: Draws, path: str) -> Column:
    """A scalar field's value: its expression, text provider, list of values, or its type's default."""
    kind = sql_type(field)
    if field.expr is not None:
        return F.expr(field.expr).cast(kind)
    if field.faker:
        return provide(field.faker, dict(field.faker_args), draws, path)
    if field.values:
        options = [literal(v, kind) for v in field.values]
        if len(options) == 1:
            return options[0]
        draw = draws.shared(path) if field.weights else draws.uniform(path)
        return pick(draw, options, field.weights)
    if field.type == "uuid":
        return _uuid(draws, path)
    if field.type == "string":
        return F.lit("value")
    if field.type == "boolean":
        return draws.uniform(path) < 0.5
    if field.type == "timestamp":
        return _moment(field, draws, path)
    if field.type == "date":
        return _day(field, draws, path)
    if field.type == "binary":
        return F.unhex(draws.digest(path))
    return _number(field, draws, path)
