"""The declarative specification: documents, and the tree that the planner reads."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path
from typing import Any

from driftloom.errors import ConfigurationError

#: Names of types in specifications.
SCALAR_TYPES = (
    "uuid", "string", "int", "long", "short", "byte", "float", "double", "decimal",
    "boolean", "timestamp", "date", "binary",
)
NESTED_TYPES = ("array", "map", "struct")
#: Ranges of numbers where a specification has none.
DEFAULT_RANGES = {
    "int": (0, 100),
    "long": (0, 9223372036854775807),
    "short": (0, 32767),
    "byte": (0, 127),
    "float": (0.0, 100.0),
    "double": (0.0, 100.0),
    "decimal": (0, 99999999.99),
}
#: Days of dates, numbers of array elements and partitions where there are none.
DEFAULT_DAYS = ("2020-01-01", "2024-12-31")
DEFAULT_LENGTHS = (1, 5)
DEFAULT_PARTITIONS = 8


@dataclass(frozen=True)
class Outlier:
    percent: float
    expr: str


@dataclass(frozen=True)
class Field:
    """One field: its type, where its values come from, and its quality options."""

    type: str
    values: tuple = ()
    weights: tuple[int, ...] = ()
    range: tuple | None = None
    begin: str | None = None
    end: str | None = None
    expr: str | None = None
    faker: str | None = None
    faker_args: tuple[tuple[str, Any], ...] = ()
    nulls: float = 0.0
    outliers: tuple[Outlier, ...] = ()
    precision: int = 10
    scale: int = 2
    inclusive: bool = False
    #: The field shows the row's event type.
    discriminator: bool = False
    item: Field | None = None
    lengths: tuple[int, int] = DEFAULT_LENGTHS
    #: Array lengths that depend on the event type alone.
    length_per_type: bool = False
    fields: tuple[tuple[str, Field], ...] = ()
    key_type: str = "string"
    value_type: str = "string"
    base_columns: tuple[str, ...] = ()


@dataclass(frozen=True)
class EventType:
    id: str
    weight: int
    fields: tuple[tuple[str, Field], ...] = ()


@dataclass(frozen=True)
class Spec:
    event_types: tuple[EventType, ...]
    common: tuple[tuple[str, Field], ...] = ()
    derived: tuple[tuple[str, Field], ...] = ()
    mode: str = "batch"
    rows: int | None = None
    partitions: int = DEFAULT_PARTITIONS
    rows_per_second: int | None = None
    partition_key: str | None = None
    #: How envelopes hold a row: "json" or "avro".
    serialization: str = "json"
    seed: int = 42
    #: "portable" draws can be recomputed by other SQL engines; "fast" ones are cheaper.
    draws: str = "fast"

    @property
    def conditional(self) -> dict[str, dict[str, Field]]:
        """Field name to event type to field, in order of first appearance.

        A name that is common as well isn't conditional: the common field wins.
        """
        common = {name for name, _ in self.common}
        out: dict[str, dict[str, Field]] = {}
        for event in self.event_types:
            for name, field in event.fields:
                if name not in common:
                    out.setdefault(name, {})[event.id] = field
        return out


def _pairs(value: Any) -> tuple:
    return tuple((value or {}).items())


def parse_field(d: dict, discriminator_allowed: bool = False) -> Field:
    """A field from its validated mapping."""
    if discriminator_allowed and d.get("event_type_id") is True:
        return Field("string", discriminator=True)
    kind = d["type"]
    limits = d.get("range")
    common = {
        "type": kind,
        "expr": d.get("expr"),
        "nulls": float(d.get("percent_nulls") or 0.0),
        "outliers": tuple(Outlier(float(o["percent"]), str(o["expr"])) for o in d.get("outliers") or ()),
        "base_columns": tuple(d.get("base_columns") or ()),
    }
    if kind == "array":
        lengths = d.get("num_features", list(DEFAULT_LENGTHS))
        lengths = (lengths, lengths) if isinstance(lengths, int) else tuple(lengths)
        inherited = ("values", "weights", "range", "begin", "end", "precision", "scale", "faker", "faker_args", "inclusive")
        inner = {"type": d.get("item_type", "string")} | {k: d[k] for k in inherited if k in d} | (d.get("item") or {})
        return Field(**common, item=parse_field(inner), lengths=lengths, length_per_type=bool(d.get("length_per_type", False)))
    if kind == "struct":
        return Field(**common, fields=tuple((n, parse_field(f)) for n, f in _pairs(d.get("fields"))))
    if kind == "map":
        return Field(
            **common,
            values=tuple(tuple(v.items()) for v in d.get("values") or ()),
            weights=tuple(d.get("weights") or ()),
            key_type=d.get("key_type", "string"),
            value_type=d.get("value_type", "string"),
        )
    if kind == "date" and limits and not d.get("begin"):
        d = d | {"begin": str(limits[0]), "end": str(limits[1])}
    return Field(
        **common,
        values=tuple(d.get("values") or ()),
        weights=tuple(d.get("weights") or ()),
        range=tuple(limits) if limits else None,
        begin=None if d.get("begin") is None else str(d["begin"]),
        end=None if d.get("end") is None else str(d["end"]),
        faker=d.get("faker"),
        faker_args=tuple(sorted((d.get("faker_args") or {}).items())),
        precision=int(d.get("precision", 10)),
        scale=int(d.get("scale", 2)),
        inclusive=bool(d.get("inclusive", False)),
    )


class Config:
    """A validated specification document; reads like the mapping that it wraps."""

    def __init__(self, data: dict) -> None:
        from driftloom.plans.validate import validate

        validate(data)
        self.data = data

    def get(self, key: str, default: Any = None) -> Any:
        """The value at a dotted path, or ``default``."""
        value: Any = self.data
        for part in key.split("."):
            if not isinstance(value, dict):
                return default
            value = value.get(part, default)
        return value

    def __getitem__(self, key: str) -> Any:
        return self.data[key]

    def __contains__(self, key: str) -> bool:
        return key in self.data

    def spec(self) -> Spec:
        """The tree that the planner reads."""
        d = self.data
        return Spec(
            event_types=tuple(
                EventType(e["event_type_id"], e["weight"], tuple((n, parse_field(f)) for n, f in _pairs(e.get("fields"))))
                for e in d["event_types"]
            ),
            common=tuple((n, parse_field(f, True)) for n, f in _pairs(d.get("common_fields"))),
            derived=tuple((n, parse_field(f)) for n, f in _pairs(d.get("derived_fields"))),
            mode=d["generation_mode"],
            rows=self.get("batch_config.total_rows"),
            partitions=self.get("batch_config.partitions", DEFAULT_PARTITIONS),
            rows_per_second=self.get("streaming_config.total_rows_per_second"),
            partition_key=self.get("sink_config.partition_key_field"),
            serialization=self.get("serialization_format", "json"),
            seed=d.get("seed", 42),
            draws=d.get("draws", "fast"),
        )


def load_config_from_dict(data: dict) -> Config:
    return Config(data)


def load_config(path: str) -> Config:
    """Read a YAML document; a missing file is a FileNotFoundError, anything else wrong a ConfigurationError."""
    import yaml

    file = Path(path)
    if not file.exists():
        raise FileNotFoundError(f"no specification at {path}")
    try:
        data = yaml.safe_load(file.read_text(encoding="utf-8"))
    except yaml.YAMLError as error:
        raise ConfigurationError(f"{path}: not valid YAML: {error}") from error
    if not data:
        raise ConfigurationError(f"{path}: the document is empty")
    if not isinstance(data, dict):
        raise ConfigurationError(f"{path}: the document isn't a mapping")
    return Config(data)
