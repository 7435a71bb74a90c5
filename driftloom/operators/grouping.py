"""Grouping sets with distinct counts, and the largest rows of each key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Logarithm of a sketch's size: at 12, an error of about 1.6 % is one standard deviation.
SKETCH_BITS = 12


def _all_sets(columns: tuple[str, ...], sets: str | list[tuple[str, ...]]) -> list[list[str]]:
    if sets == "cube":
        return [[c for k, c in enumerate(columns) if not number >> k & 1] for number in range(1 << len(columns))]
    if sets == "rollup":
        return [list(columns[:k]) for k in range(len(columns), -1, -1)]
    if isinstance(sets, str):
        raise ValueError("sets are 'cube', 'rollup' or a list of columns' names")
    return [list(s) for s in sets]


def grouping_sets(
    events: DataFrame, columns: tuple[str, ...], sets: str | list[tuple[str, ...]], distinct: str, measure: str | None = None, bits: int = SKETCH_BITS
) -> DataFrame:
    """Rows, distinct values of ``distinct`` and the sum of ``measure`` for several groupings.

    Rows are aggregated once, to the finest groups that occur, each with a sketch of
    ``distinct``; the groupings are expanded from these groups and their sketches united, so what is
    repeated for each grouping are groups, never rows.  ``groups`` says which columns are grouped:
    bit k, from the last column on, is 1 where a column is not, so a null there differs from a
    null value.  ``distinct_about`` is an estimate within a few hundredths; nulls of ``distinct``
    don't count.  ``measure`` is summed without its nulls.  An empty table has no groups, the
    one of all rows included.
    """
    stats = [F.count("*").alias("rows"), F.hll_sketch_agg(distinct, bits).alias("sketch")]
    stats += [F.sum(measure).alias("total")] if measure else []
    finest = events.groupBy(*columns).agg(*stats)
    # a null sketch stands for no values at all
    merged = [F.sum("rows").alias("rows"), F.hll_union_agg("sketch").alias("sketch")]
    merged += [F.sum("total").alias(f"sum_{measure}")] if measure else []
    out = finest.groupingSets(_all_sets(columns, sets), *columns).agg(F.grouping_id(*columns).alias("groups"), *merged)
    about = F.coalesce(F.hll_sketch_estimate("sketch"), F.lit(0)).alias("distinct_about")
    return out.select(*columns, "groups", "rows", about, *([f"sum_{measure}"] if measure else []))


def exact_grouping_sets(events: DataFrame, columns: tuple[str, ...], sets: str | list[tuple[str, ...]], distinct: str) -> DataFrame:
    """``groups``, rows and the exact number of distinct values for several groupings.

    Values are made distinct once, with their rows counted, before the groupings are expanded; so a
    value is repeated for each grouping, and a row isn't.  Nulls don't count as a value; an empty
    table has no groups.
    """
    once = events.groupBy(*columns, F.col(distinct).alias("value_")).agg(F.count("*").alias("n_"))
    out = once.groupingSets(_all_sets(columns, sets), *columns).agg(
        F.grouping_id(*columns).alias("groups"), F.sum("n_").alias("rows"), F.countDistinct("value_").alias("distinct_values")
    )
    return out.select(*columns, "groups", "rows", "distinct_values")


def top_by_key(df: DataFrame, keys: tuple[str, ...], order: list[Column], k: int, ties: bool = False) -> DataFrame:
    """The first ``k`` rows of each key by ``order``, with their ``place``.

    Every task leaves ``k`` rows of a key before the exchange, so a key with a third of all rows
    brings ``k`` rows of each task together.  Without ``ties`` rows that are equal in
    ``order`` follow in the order of all other columns, so the result is one and the same;
    with ``ties`` all rows that are equal to the k-th come too, and share their place.
    Null keys are a key.
    """
    place = "place"
    while place in df.columns:
        place += "_"
    rest = [] if ties else [F.col(f"`{c}`") for c in df.columns]
    ranked = (F.rank() if ties else F.row_number()).over(Window.partitionBy(*keys).orderBy(*order, *rest))
    return df.withColumn(place, ranked).filter(F.col(place) <= k)


def top(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of all by ``order``, then by all columns; each task leaves ``k``."""
    return df.orderBy(*order, *(F.col(f"`{c}`") for c in df.columns)).limit(k)
