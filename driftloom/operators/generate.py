"""Generation: from a specification and row ids to a wide table.

The plan is four projections: draws and the event type; common and conditional
fields; derived fields, as many layers as they need; the visible columns.  There is no
shuffle, every column is a deterministic expression of the id, and so filters on the
event type and unused fields are pushed down and pruned by the optimizer.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from itertools import accumulate

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.errors import ConfigurationError
from driftloom.functions.draws import Draws
from driftloom.functions.nested import valued, with_quality
from driftloom.functions.scalars import sql_type
from driftloom.operators.envelope import to_envelope
from driftloom.plans.spec import Config, Field, Spec
from driftloom.sources.rows import batch_rows, stream_rows

ROW_ID, TYPE_NUMBER, EVENT_TYPE = "__row_id", "__type_number", "__event_type"
#: Path of the draw that decides a row's event type.
TYPE_PATH = "__type"


def type_number(spec: Spec, draw: Column) -> Column:
    """The number of a row's event type by weight: a balanced tree of comparisons with one draw."""
    bounds = list(accumulate(e.weight for e in spec.event_types))
    total = float(bounds[-1])

    def tree(lo: int, hi: int) -> Column:
        if hi - lo == 1:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(draw < F.lit(bounds[mid - 1] / total), tree(lo, mid)).otherwise(tree(mid, hi))

    return tree(0, len(bounds))


def type_name(spec: Spec, number: Column) -> Column:
    """The event type of a number: a lookup in one literal array."""
    ids, mark = [e.id for e in spec.event_types], "\u0001"
    if any(mark in i for i in ids):
        return F.element_at(F.array(*map(F.lit, ids)), number + 1)
    return F.element_at(F.split(F.lit(mark.join(ids)), mark), number + 1)


def type_of(spec: Spec, u: float) -> str:
    """The event type that the planner gives for a draw; for tests and tools."""
    bounds = list(accumulate(e.weight for e in spec.event_types))
    return spec.event_types[bisect_right([b / bounds[-1] for b in bounds[:-1]], u)].id


def _conditional(name: str, by_type: dict[str, Field], draws: Draws, which: Column, numbers: dict[str, int]) -> Column:
    """A field with a specification per event type, null for the others.

    Event types with equal specifications share a branch and its draws.
    """
    groups: dict[Field, list[str]] = {}
    for event, field in by_type.items():
        groups.setdefault(field, []).append(event)
    out = None
    for field, events in groups.items():
        here = F.col(TYPE_NUMBER).isin([numbers[e] for e in events])
        branch = valued(field, draws, f"{name}@{events[0]}", which)
        out = F.when(here, branch) if out is None else out.when(here, branch)
    return out


def _derived_layers(spec: Spec) -> list[list[tuple[str, Field]]]:
    """Derived fields in order; a new layer where one uses another of its layer."""
    layers: list[list[tuple[str, Field]]] = []
    for name, field in spec.derived:
        used = set(re.findall(r"\w+", field.expr)) | set(field.base_columns)
        if not layers or used & {n for n, _ in layers[-1]}:
            layers.append([])
        layers[-1].append((name, field))
    return layers


def generate(rows: DataFrame, row_id: str, spec: Spec, keep: tuple[str, ...] = ()) -> DataFrame:
    """Generate ``spec``'s fields for each row of ``rows`` from its unique ``row_id``.

    Columns named in ``keep`` come first.  A null id gives null draws; the last event
    type then, and null numbers.
    """
    draws = Draws(spec.seed, F.col(ROW_ID), spec.draws)
    which = F.col(EVENT_TYPE)
    names = [n for n, _ in spec.common]
    clash = set(keep) & {*names, *spec.conditional, *(n for n, _ in spec.derived)}
    if clash:
        raise ConfigurationError(f"columns {sorted(clash)} are both kept and generated")
    columns = [valued(f, draws, n, which).alias(n) for n, f in spec.common]
    numbers = {e.id: k for k, e in enumerate(spec.event_types)}
    columns += [_conditional(n, by, draws, which, numbers).alias(n) for n, by in spec.conditional.items()]
    first = draws.shared(TYPE_PATH)
    base = rows.select(*(F.col(k) for k in keep), F.col(row_id).alias(ROW_ID))
    drawn = base.select("*", *(c.alias(n) for n, c in draws.sheet.items()))
    numbered = drawn.select("*", type_number(spec, first).alias(TYPE_NUMBER))
    typed = numbered.select("*", type_name(spec, F.col(TYPE_NUMBER)).alias(EVENT_TYPE))
    out = typed.select(*(F.col(k) for k in keep), ROW_ID, EVENT_TYPE, *columns)
    for layer in _derived_layers(spec):
        own = Draws(spec.seed, F.col(ROW_ID), spec.draws)
        made = [with_quality(F.expr(f.expr).cast(sql_type(f)), f, own, n).alias(n) for n, f in layer]
        try:
            out = out.select("*", *(c.alias(n) for n, c in own.sheet.items())).select(*out.columns, *made)
        except AnalysisException as error:
            where = ", ".join(f"derived_fields.{n}" for n, _ in layer)
            raise ConfigurationError(f"{where}: {error.getMessage().splitlines()[0]}") from error
    return out.drop(ROW_ID, EVENT_TYPE)


class Generator:
    """Tables of one specification: over a range of ids, a stream of them, or an existing table."""

    def __init__(self, spark: SparkSession, spec: Spec) -> None:
        self.spark, self.spec = spark, spec

    def batch(self, rows: int | None = None) -> DataFrame:
        n = self.spec.rows if rows is None else rows
        return generate(batch_rows(self.spark, n, self.spec.partitions), "id", self.spec)

    def stream(self, partitions: int | None = None, ramp_up: str | None = None) -> DataFrame:
        return generate(stream_rows(self.spark, self.spec.rows_per_second, partitions, ramp_up), "id", self.spec)

    def apply(self, rows: DataFrame, row_id: str, keep: tuple[str, ...] = ()) -> DataFrame:
        return generate(rows, row_id, self.spec, keep)

    def wide(self) -> DataFrame:
        return self.stream() if self.spec.mode == "streaming" else self.batch()


class StreamOrchestrator:
    """The table or stream that a configuration describes, wide or as keyed envelopes."""

    def __init__(self, spark: SparkSession, config: Config) -> None:
        self.spark, self.config, self.spec = spark, config, config.spec()

    def calculate_rates(self) -> dict[str, float]:
        """Rows per second of each event type; empty in batch mode."""
        from driftloom.operators.sizing import rates

        return rates(self.spec)

    def create_unified_stream(self, serialize: bool = True) -> DataFrame:
        wide = Generator(self.spark, self.spec).wide()
        return to_envelope(wide, self.spec) if serialize else wide
