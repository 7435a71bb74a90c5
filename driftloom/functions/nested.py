"""Values of arrays, structs and maps, and the quality options of any field."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftloom.functions.draws import Draws, pick
from driftloom.functions.scalars import literal, scalar, sql_type
from driftloom.plans.spec import Field


def _array(field: Field, draws: Draws, path: str, event_type: Column | None) -> Column:
    low, high = field.lengths
    kind = sql_type(field)
    if high == 0:
        return F.array().cast(kind)
    elements = F.array(*(valued(field.item, draws, f"{path}[{k}]", event_type) for k in range(high))).cast(kind)
    if low == high:
        return elements
    if field.length_per_type and event_type is not None:
        length = F.abs(F.hash(event_type)) % (high - low + 1) + low
    else:
        length = draws.index(high - low + 1, path, "length") + low
    return F.slice(elements, F.lit(1), length)


def _map(field: Field, draws: Draws, path: str) -> Column:
    kind = sql_type(field)
    keys, values = sql_type(Field(field.key_type)), sql_type(Field(field.value_type))
    options = [
        F.create_map(*(x for k, v in option for x in (literal(k, keys), literal(v, values)))).cast(kind)
        if option
        else F.create_map().cast(kind)
        for option in field.values
    ]
    if not options:
        return F.create_map().cast(kind)
    draw = draws.shared(path) if field.weights else draws.uniform(path)
    return pick(draw, options, field.weights)


def value(field: Field, draws: Draws, path: str, event_type: Column | None = None) -> Column:
    """A field's value without its quality options."""
    if field.discriminator:
        return event_type
    if field.expr is not None:
        return F.expr(field.expr).cast(sql_type(field))
    if field.type == "array":
        return _array(field, draws, path, event_type)
    if field.type == "struct":
        return F.struct(*(valued(f, draws, f"{path}.{n}", event_type).alias(n) for n, f in field.fields))
    if field.type == "map":
        return _map(field, draws, path)
    return scalar(field, draws, path)


def with_quality(core: Column, field: Field, draws: Draws, path: str) -> Column:
    """Outliers over a value, nulls over both.

    One draw decides whether a row is an outlier, another one which; so each has its
    exact share.
    """
    kind = sql_type(field)
    out = core
    if field.outliers:
        total = sum(o.percent for o in field.outliers)
        chosen, below = F.expr(field.outliers[-1].expr).cast(kind), total - field.outliers[-1].percent
        for outlier in reversed(field.outliers[:-1]):
            option = F.expr(outlier.expr).cast(kind)
            chosen = F.when(draws.shared(path, "which") < F.lit(below / total), option).otherwise(chosen)
            below -= outlier.percent
        out = F.when(draws.uniform(path, "outlier") < F.lit(total), chosen).otherwise(out)
    if field.nulls:
        out = F.when(draws.uniform(path, "null") >= F.lit(field.nulls), out)
    return out


def valued(field: Field, draws: Draws, path: str, event_type: Column | None = None) -> Column:
    """A field's value with its quality options."""
    return with_quality(value(field, draws, path, event_type), field, draws, path)
