"""Checks of a specification document, before anything is planned.

Every message begins with the path of what is wrong.  Options of nested fields are
checked at any depth.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from driftloom.errors import ConfigurationError
from driftloom.plans.spec import DEFAULT_RANGES, NESTED_TYPES, SCALAR_TYPES

#: Columns whose names begin so are the planner's own.
RESERVED_PREFIX = "__"
#: Whole numbers that a type can hold.
_LIMITS = {"byte": 7, "short": 15, "int": 31, "long": 63}
_SOURCES = ("values", "range", "expr", "faker")


def _need(ok: Any, where: str, what: str) -> None:
    if not ok:
        raise ConfigurationError(f"{where}: {what}")


def _is_whole(x: Any) -> bool:
    return isinstance(x, int) and not isinstance(x, bool)


def _is_number(x: Any) -> bool:
    return isinstance(x, int | float) and not isinstance(x, bool)


def validate(data: dict) -> None:
    """Raise a ConfigurationError for the first rule that ``data`` breaks."""
    _need(isinstance(data, dict), "document", "must be a mapping")
    for key in ("event_types", "generation_mode", "sink_config"):
        _need(key in data, key, "is required")
    _event_types(data["event_types"])
    _mode(data)
    _need(isinstance(data["sink_config"], dict) and "type" in data["sink_config"], "sink_config.type", "is required")
    _need(data.get("draws", "fast") in ("fast", "portable"), "draws", "must be 'fast' or 'portable'")
    formats = ("json", "avro")
    _need(data.get("serialization_format", "json") in formats, "serialization_format", f"must be one of {formats}; others aren't written")
    _need(_is_whole(data.get("seed", 42)), "seed", "must be a whole number")
    for where, name, field in _top_fields(data):
        _need(not name.startswith(RESERVED_PREFIX), where, f"names that begin with {RESERVED_PREFIX!r} are reserved")
        _need(isinstance(field, dict), where, "must be a mapping")
        if "event_type_id" in field:
            _discriminator(where, field)
        elif where.startswith("derived_fields"):
            _derived(where, field)
        else:
            _field(where, field)
    _consistency(data)
    _partition_key(data)


def _event_types(events: Any) -> None:
    _need(isinstance(events, list) and events, "event_types", "at least one event type is required")
    seen = set()
    for k, event in enumerate(events):
        where = f"event_types[{k}]"
        _need(isinstance(event, dict) and isinstance(event.get("event_type_id"), str), where, "event_type_id must be a string")
        weight = event.get("weight")
        _need(_is_whole(weight) and weight > 0, f"{where}.weight", "must be a positive whole number, such as 6, 3, 1 for 60, 30, 10 %")
        _need(event["event_type_id"] not in seen, where, f"event_type_id {event['event_type_id']!r} occurs twice")
        seen.add(event["event_type_id"])


def _mode(data: dict) -> None:
    mode = data["generation_mode"]
    _need(mode in ("streaming", "batch"), "generation_mode", f"must be 'streaming' or 'batch', not {mode!r}")
    block = f"{mode}_config"
    _need(isinstance(data.get(block), dict), block, f"is required in {mode} mode")
    if mode == "streaming":
        rate = data[block].get("total_rows_per_second")
        _need(_is_whole(rate) and rate > 0, f"{block}.total_rows_per_second", "must be a positive whole number")
    else:
        rows = data[block].get("total_rows")
        _need(_is_whole(rows) and rows >= 0, f"{block}.total_rows", "must be a whole number")
        parts = data[block].get("partitions", 1)
        _need(_is_whole(parts) and parts > 0, f"{block}.partitions", "must be a positive whole number")


def _top_fields(data: dict) -> Iterator[tuple[str, str, Any]]:
    for name, field in (data.get("common_fields") or {}).items():
        yield f"common_fields.{name}", name, field
    for event in data["event_types"]:
        for name, field in (event.get("fields") or {}).items():
            yield f"{event['event_type_id']}.fields.{name}", name, field
    for name, field in (data.get("derived_fields") or {}).items():
        yield f"derived_fields.{name}", name, field


def _discriminator(where: str, field: dict) -> None:
    _need(where.startswith("common_fields"), where, "event_type_id is for common fields only")
    _need(field["event_type_id"] is True, f"{where}.event_type_id", "must be true")
    clash = [k for k in (*_SOURCES, "weights", "outliers", "percent_nulls") if k in field]
    _need(not clash, where, f"event_type_id excludes {', '.join(clash)}")
    _need(field.get("type", "string") == "string", where, "event_type_id is always a string")


def _derived(where: str, field: dict) -> None:
    _need(field.get("expr"), f"{where}.expr", "is required")
    _need(field.get("type"), f"{where}.type", "is required")
    _need(field["type"] in SCALAR_TYPES, f"{where}.type", f"unknown type {field['type']!r}")
    clash = [k for k in ("values", "range", "faker") if k in field]
    _need(not clash, where, f"derived fields have an expression only, not {', '.join(clash)}")
    _quality(where, field)


def _field(where: str, field: dict) -> None:
    kind = field.get("type")
    _need(kind in SCALAR_TYPES + NESTED_TYPES, f"{where}.type", f"unknown type {kind!r}")
    _quality(where, field)
    _faker(where, field, "item_type" if kind == "array" else "type")
    if kind == "struct":
        inner = field.get("fields")
        _need(isinstance(inner, dict) and inner, f"{where}.fields", "a struct needs fields")
        for name, sub in inner.items():
            _need(isinstance(sub, dict), f"{where}.{name}", "must be a mapping")
            _field(f"{where}.{name}", sub)
    elif kind == "array":
        _array(where, field)
    elif kind == "map":
        _map(where, field)
    else:
        _values(where, field, kind)
        _range(where, field, kind)


def _quality(where: str, field: dict) -> None:
    nulls = field.get("percent_nulls")
    if nulls is not None:
        _need(_is_number(nulls) and 0 <= nulls < 1, f"{where}.percent_nulls", "must be at least 0 and below 1")
    outliers = field.get("outliers")
    if outliers is None:
        return
    _need(isinstance(outliers, list), f"{where}.outliers", "must be a list")
    total = 0.0
    for k, o in enumerate(outliers):
        at = f"{where}.outliers[{k}]"
        _need(isinstance(o, dict) and "percent" in o, f"{at}.percent", "is required")
        _need(_is_number(o["percent"]) and 0 < o["percent"] < 1, f"{at}.percent", "must be between 0 and 1")
        _need("expr" in o, f"{at}.expr", "is required")
        total += o["percent"]
    _need(total <= 1 + 1e-9, f"{where}.outliers", "percents add up to more than 1")


def _faker(where: str, field: dict, type_key: str) -> None:
    if "faker" not in field:
        _need("faker_args" not in field, f"{where}.faker_args", "needs faker")
        return
    _need(field.get(type_key) == "string", where, "text providers are for strings only")
    clash = [k for k in ("values", "range", "expr") if k in field]
    _need(not clash, where, f"faker excludes {', '.join(clash)}")
    _need(isinstance(field["faker"], str) and field["faker"].strip(), f"{where}.faker", "must be the name of a method")
    _need(isinstance(field.get("faker_args", {}), dict), f"{where}.faker_args", "must be a mapping")


def _weights(where: str, field: dict, n: int) -> None:
    weights = field.get("weights")
    if weights is None:
        return
    ok = isinstance(weights, list) and all(_is_whole(w) and w > 0 for w in weights)
    _need(ok, f"{where}.weights", f"must be positive whole numbers, such as 2, 4, 4 instead of 0.2, 0.4, 0.4; they are {weights!r}")
    _need(len(weights) == n, f"{where}.weights", f"{len(weights)} weights for {n} values")


def _values(where: str, field: dict, kind: str) -> None:
    if "values" not in field:
        _need("weights" not in field, f"{where}.weights", "needs values")
        return
    values = field["values"]
    _need(isinstance(values, list) and values, f"{where}.values", "must be a list of values")
    _need(kind not in ("uuid", "binary"), f"{where}.values", f"a {kind} has no values to choose from")
    _weights(where, field, len(values))


def _range(where: str, field: dict, kind: str) -> None:
    if "range" in field:
        limits = field["range"]
        _need(isinstance(limits, list | tuple) and len(limits) == 2, f"{where}.range", "must be [lowest, highest]")
        if kind == "date":
            return
        _need(kind in DEFAULT_RANGES, f"{where}.range", f"a {kind} has no range")
        _need(all(map(_is_number, limits)) and limits[0] <= limits[1], f"{where}.range", "must be two ascending numbers")
    elif any(field.get(k) is not None for k in ("values", "expr", "faker")):
        return  # the type's default range isn't used
    low, high = field.get("range") or DEFAULT_RANGES.get(kind, (0, 0))
    if kind in _LIMITS:
        most = 2 ** _LIMITS[kind]
        _need(-most <= low and high <= most - 1, f"{where}.range", f"goes beyond a {kind}")
    if kind == "decimal":
        precision, scale = field.get("precision", 10), field.get("scale", 2)
        _need(_is_whole(precision) and _is_whole(scale) and 0 < precision <= 38 and 0 <= scale <= precision, where, "bad precision or scale")
        _need(max(abs(low), abs(high)) < 10 ** (precision - scale), f"{where}.range", f"goes beyond decimal({precision},{scale})")


def _array(where: str, field: dict) -> None:
    item = field.get("item_type", "string")
    _need(item in SCALAR_TYPES, f"{where}.item_type", f"unknown type {item!r}")
    lengths = field.get("num_features", [1, 5])
    ok = (_is_whole(lengths) and lengths >= 0) or (
        isinstance(lengths, list | tuple) and len(lengths) == 2 and all(map(_is_whole, lengths)) and 0 <= lengths[0] <= lengths[1]
    )
    _need(ok, f"{where}.num_features", "must be a number of elements, or [least, most]")
    _values(where, field, item)
    _range(where, field, item)
    if "item" in field:
        _need(isinstance(field["item"], dict), f"{where}.item", "must be a mapping")
        _field(f"{where}.item", {"type": item} | field["item"])


def _map(where: str, field: dict) -> None:
    for key in ("key_type", "value_type"):
        _need(field.get(key, "string") in SCALAR_TYPES, f"{where}.{key}", f"unknown type {field.get(key)!r}")
    values = field.get("values", [])
    _need(isinstance(values, list) and all(isinstance(v, dict) for v in values), f"{where}.values", "must be a list of mappings")
    _weights(where, field, len(values))


def _shape(field: dict) -> Any:
    """What fields of one name must agree on."""
    if field.get("event_type_id") is True:
        return "string"
    kind = field["type"]
    if kind == "struct":
        return kind, tuple(sorted((n, _shape(f)) for n, f in field["fields"].items()))
    if kind == "array":
        return kind, field.get("item_type", "string")
    if kind == "map":
        return kind, field.get("key_type", "string"), field.get("value_type", "string")
    if kind == "decimal":
        return kind, field.get("precision", 10), field.get("scale", 2)
    return kind


def _consistency(data: dict) -> None:
    first: dict[str, tuple[str, Any]] = {}
    for where, name, field in _top_fields(data):
        if where.startswith("derived_fields"):
            _need(name not in first, where, f"the name is taken by {first.get(name, ('',))[0]}")
            continue
        at, shape = first.setdefault(name, (where, _shape(field)))
        _need(shape == _shape(field), where, f"its type differs from {at}")


def _partition_key(data: dict) -> None:
    key = data["sink_config"].get("partition_key_field")
    if key is not None:
        names = {name for _, name, _ in _top_fields(data)} | {"event_timestamp"}
        _need(key in names, "sink_config.partition_key_field", f"there is no field {key!r}")
