"""Column expressions over long arrays and texts, in time that grows with their length.

``aggregate`` copies a growing array at each step, and ``substring`` counts code points
from a text's start; over thousands of elements either takes the square of their number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that one pass copies; code points of a piece of a text.
CHUNK, PIECE = 64, 1 << 10


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _folds(values: Column, start: Column, step: Callable[[Column, Column], Column]) -> Column:
    """What ``step`` has made of the elements before each one; takes the square of their number."""
    none = F.slice(F.array(start), 1, 0)
    return F.aggregate(
        values,
        F.struct(start.alias("now"), none.alias("before")),
        lambda a, x: F.struct(step(a["now"], x).alias("now"), F.array_append(a["before"], a["now"]).alias("before")),
        lambda a: a["before"],
    )


def running(values: Column, step: Callable[[Column, Column], Column], levels: int = 3) -> Column:
    """For each of some whole numbers, ``step`` over those before it, from 0 on.

    ``step`` is associative (a sum, a maximum).  Chunks of ``CHUNK`` are folded, then
    chunks of their totals, and so on: up to ``CHUNK`` to the power ``levels`` elements,
    the time is in proportion to their number.
    """
    zero = F.lit(0)
    if levels == 1:
        return _folds(values, zero, step)

    def by_chunk(v: Column) -> Column:
        last = F.floor((F.size(v) - 1) / CHUNK).cast("int")
        chunks = F.transform(F.sequence(zero, last), lambda k: F.slice(v, k * CHUNK + 1, CHUNK))
        return let(chunks, whole)

    def whole(chunks: Column) -> Column:
        totals = F.transform(chunks, lambda c: F.aggregate(c, zero, step))
        return let(totals, lambda t: F.flatten(F.zip_with(chunks, running(t, step, levels - 1), lambda c, s: _folds(c, s, step))))

    return let(values, lambda v: F.when(F.size(v) > 0, by_chunk(v)).otherwise(F.slice(v, 1, 0)))


def sums_before(values: Column) -> Column:
    return running(values, lambda a, x: a + x)


def largest_before(values: Column) -> Column:
    return running(values, lambda a, x: F.greatest(a, x))


def pieces(text: Column) -> Column:
    """A text cut into pieces of ``PIECE`` code points, for ``cut``."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def cut(parts: Column, start: Column, end: Column) -> Column:
    """Code points from ``start`` to before ``end`` of the text that ``parts`` are the pieces of."""

    def of(k: Column) -> Column:
        low, high = F.greatest(start - k * PIECE, F.lit(0)), F.least(end - k * PIECE, F.lit(PIECE))
        return F.substring(F.element_at(parts, k + 1), low + 1, high - low)

    piece = lambda at: F.floor(at / PIECE).cast("int")
    found = F.array_join(F.transform(F.sequence(piece(start), piece(end - 1)), of), "")
    return F.when(end > start, found).otherwise(F.lit(""))
