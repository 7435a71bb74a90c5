"""Joins by time, by range, and of keys with very many rows.  Each is one DataFrame from two.

None compares all pairs of a key: as-of joins sort once and carry a value on, range joins
become equi-joins of bins, and keys with very many rows are dealt to several tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftloom.sources.shared import checkpointed

#: Rows of a key above which it is cut or dealt out; ranges of time for such a key at most.
HOT_ROWS, RANGES = 1_000_000, 256
#: Keys that may count as heavy: the only rows that are broadcast.
HEAVY_KEYS = 1000


def _unused(name: str, *frames: DataFrame) -> str:
    taken = {c.lower() for f in frames for c in f.columns}
    while name in taken:
        name += "_"
    return name


def asof(
    left: DataFrame, right: DataFrame, keys: tuple[str, ...], left_time: str, right_time: str, values: tuple[str, ...],
    within: str | None = None, hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Each row of ``left`` with ``values`` of the last row of ``right`` at or before its time, per ``keys``.

    Both sides are united, sorted once, and the last right row is carried on in a window.
    A key of more than ``hot_rows`` rows is cut into ranges of about equal numbers of rows,
    each a task of its own; what is carried into a range comes from a small table of the
    ranges' last rows.

    All left rows stay, repeated ones too.  A row without a match, with a null key or with a
    null time has null values.  A right row with a null key or time matches nothing; nulls in
    ``values`` are carried like others.  Of right rows of one key and time the greatest by
    ``values`` counts.  ``within`` (an interval such as "1 hour") leaves out older ones.
    ``values`` must have other names than the columns of ``left``.
    """
    clash = sorted(set(values) & set(left.columns))
    if clash:
        raise ValueError(f"{clash} are columns of both sides; rename them on the right")
    at, row, found, bin_, cuts = (_unused(n, left, right) for n in ("asof_at", "asof_row", "asof_found", "asof_bin", "asof_cuts"))
    good = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys], F.col(right_time).isNotNull())
    packed = F.struct(*(F.col(c).alias(f"c{i}") for i, c in enumerate(left.columns)))
    key = [F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]
    kind = F.struct(F.col(right_time).alias("time"), *(F.col(v).alias(f"v{i}") for i, v in enumerate(values)))
    ours = left.select(*key, F.col(left_time).alias(at), packed.alias(row))
    theirs = right.filter(good).select(*key, F.col(right_time).alias(at), kind.alias(found))
    both = theirs.unionByName(ours, allowMissingColumns=True)
    names = [f"k{i}" for i in range(len(keys))]
    micros = F.unix_micros(F.col(at).cast("timestamp")) if dict(left.dtypes)[left_time].startswith("timestamp") else F.col(at)
    # only keys of very many rows are cut: their quantiles are a table of few rows
    hot = both.groupBy(*names).agg(F.count("*").alias("n")).filter(F.col("n") > hot_rows).drop("n")
    some_hot = bool(hot.take(1))
    if some_hot:
        shares = [k / RANGES for k in range(1, RANGES)]
        edges = both.join(hot, names, "left_semi").groupBy(*names).agg(F.array_distinct(F.percentile_approx(micros, shares)).alias(cuts))
        # quantiles depend on the order in which parts are merged, so they are taken once: rows and ends need the same ranges
        edges = checkpointed(edges)
        binned = both.join(edges, names, "left").withColumn(bin_, F.coalesce(F.size(F.filter(cuts, lambda c: c <= micros)), F.lit(0))).drop(cuts)
        binned = binned.withColumn(bin_, F.when(F.col(bin_) < 0, 0).otherwise(F.col(bin_)))
    else:
        binned = both.withColumn(bin_, F.lit(0))
    # at equal times right rows come first, in the order of their values
    order = [F.col(at).asc_nulls_first(), F.col(row).isNotNull(), F.col(found).asc_nulls_first()]
    inside = Window.partitionBy(*names, bin_).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    carried = binned.withColumn(found, F.last(found, ignorenulls=True).over(inside))
    if some_hot:
        ends = binned.filter(F.col(found).isNotNull()).groupBy(*names, bin_).agg(F.max(found).alias("end"))
        ends = ends.join(hot, names, "left_semi")
        gaps = binned.join(hot, names, "left_semi").select(*names, bin_).distinct().join(ends, [*names, bin_], "left")
        earlier = Window.partitionBy(*names).orderBy(bin_).rowsBetween(Window.unboundedPreceding, -1)
        gaps = gaps.withColumn("end", F.last("end", ignorenulls=True).over(earlier))
        carried = carried.join(gaps, [*names, bin_], "left").withColumn(found, F.coalesce(found, "end"))
    got = F.when(F.col(at).isNotNull(), F.col(found))
    if within is not None:
        got = F.when(F.col(found)["time"] >= F.col(at) - F.expr(f"INTERVAL {within}"), got)
    return carried.filter(F.col(row).isNotNull()).select(
        *(F.col(row)[f"c{i}"].alias(c) for i, c in enumerate(left.columns)), *(got[f"v{i}"].alias(v) for i, v in enumerate(values))
    )


def _widths(base: int) -> list[int]:
    out = [1]
    while out[-1] * base < 1 << 62:
        out.append(out[-1] * base)
    return out


def _level(size: Column, base: int) -> Column:
    """The place of the least width that isn't below ``size``, the last one for longer ones."""
    widths = _widths(base)
    out = F.lit(len(widths) - 1)
    for level, edge in reversed(list(enumerate(widths))):
        out = F.when(size <= edge, level).otherwise(out)
    return out


def within_intervals(
    points: DataFrame, intervals: DataFrame, point: str, start: str, end: str, keys: tuple[str, ...] = (), how: str = "inner", base: int = 8
) -> DataFrame:
    """Points with the intervals that hold them: start <= point < end, whole numbers.

    Bins are drawn from the intervals' lengths: one of a length between two powers of
    ``base`` goes to the one or two bins of the larger power that it meets, so long intervals
    don't become many rows, and short ones don't share bins with all others.  A point goes to one
    bin for each size that occurs (22 at most).  The join is an equi-join by size, bin and
    ``keys``; the exact condition follows.

    ``how`` is "inner" or "left" (points without an interval stay, with nulls).  Null points and
    bounds match nothing; empty intervals (end <= start) hold nothing; repeated rows match each
    for itself.  The other columns of the two sides must have different names.
    """
    if how not in ("inner", "left"):
        raise ValueError("how is 'inner' or 'left'")
    clash = sorted((set(points.columns) & set(intervals.columns)) - set(keys))
    if clash:
        raise ValueError(f"{clash} are columns of both sides; rename them")
    size, bin_, row = (_unused(n, points, intervals) for n in ("bin_size", "bin_no", "bin_row"))
    width = lambda level: F.element_at(F.array(*map(F.lit, _widths(base))), level + 1)
    level = _level(F.col(end) - F.col(start), base)
    sound = intervals.filter(F.col(start) < F.col(end)).withColumn(size, level)
    first, last = (_floor_div(x, width(F.col(size))) for x in (F.col(start), F.col(end) - 1))
    dealt = sound.withColumn(bin_, F.explode(F.sequence(first, last)))
    sizes = [r[0] for r in sound.select(size).distinct().collect()]  # as many as there are powers at most
    asked = F.array(*map(F.lit, sizes)) if sizes else F.array().cast("array<int>")
    placed = points.filter(F.col(point).isNotNull()).withColumn(size, F.explode(asked))
    placed = placed.withColumn(bin_, _floor_div(F.col(point), width(F.col(size))))
    met = placed.join(dealt, [*keys, size, bin_]).filter((F.col(start) <= F.col(point)) & (F.col(point) < F.col(end))).drop(size, bin_)
    if how == "inner":
        return met
    # the points that no interval holds come back by their content, repeated ones as often as they are
    held = met.select(*points.columns).distinct()
    same = reduce(lambda a, b: a & b, [points[c].eqNullSafe(held[c]) for c in points.columns])
    return met.unionByName(points.join(held, same, "left_anti"), allowMissingColumns=True)


def interval_totals(
    points: DataFrame, intervals: DataFrame, point: str, start: str, end: str, totals: dict[str, Column], keys: tuple[str, ...] = ()
) -> DataFrame:
    """All intervals with sums over the points that they hold: start <= point < end, whole numbers.

    No pair of point and interval is made: the points' sums are carried on along the times that
    occur, and an interval's are what lies between its two ends.  Times are cut into ranges of
    about equal numbers of them, each sorted by itself; what is carried into a range comes from a
    small table of the ranges' sums.  So work grows with the rows, however many points an interval holds.

    ``totals`` names the sums and says what each adds up, whole numbers or decimals, for which
    differences are exact; nulls in it count as 0.  Intervals that hold nothing, are empty
    (end <= start), or have a null bound or key have sums of 0.  Null points are in none; repeated
    rows count each for itself.  Other names of ``points`` may be those of ``intervals``.
    """
    clash = sorted(set(totals) & set(intervals.columns))
    if clash:
        raise ValueError(f"{clash} are columns of the intervals; rename the sums")
    at, part, low, high = (_unused(n, points, intervals) for n in ("totals_at", "totals_part", "totals_low", "totals_high"))
    valued = points.select(*keys, F.col(point).cast("long").alias(at), *(c.alias(n) for n, c in totals.items()))
    rough = sorted(n for n, kind in valued.dtypes if n in totals and kind not in ("tinyint", "smallint", "int", "bigint") and not kind.startswith("decimal"))
    if rough:
        raise ValueError(f"{rough} aren't whole numbers or decimals")
    zero = lambda c: F.coalesce(c, F.lit(0))
    sums = lambda over=None: (zero(F.sum(n) if over is None else F.sum(n).over(over)).alias(n) for n in totals)
    sound = intervals.filter(F.col(start) < F.col(end))
    ends = sound.select(*keys, F.explode(F.array(F.col(start).cast("long"), F.col(end).cast("long"))).alias(at))
    both = valued.unionByName(ends, allowMissingColumns=True).dropna(subset=[*keys, at])
    steps = both.groupBy(*keys, at).agg(*sums())
    # the ranges come from a sample: they are taken once
    steps = checkpointed(steps.repartitionByRange(*keys, at).withColumn(part, F.spark_partition_id()))
    inside = Window.partitionBy(*keys, part).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    ranges = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    earlier = steps.groupBy(*keys, part).agg(*sums()).select(*keys, part, F.struct(*sums(ranges)).alias(low))
    here = steps.select(*keys, part, at, F.struct(*sums(inside)).alias(high)).join(earlier, [*keys, part])
    before = here.select(*keys, at, F.struct(*((F.col(low)[n] + F.col(high)[n]).alias(n) for n in totals)).alias(low))
    out = intervals
    for bound, name in ((start, low), (end, high)):
        known = before.select(*(F.col(k).alias(f"{at}{i}") for i, k in enumerate(keys)), F.col(at), F.col(low).alias(name))
        on = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"{at}{i}") for i, k in enumerate(keys)], F.col(bound) == F.col(at))
        out = out.join(known, on, "left").drop(at, *(f"{at}{i}" for i in range(len(keys))))
    held = F.col(start) < F.col(end)
    return out.select(*intervals.columns, *(zero(F.when(held, F.col(high)[n] - F.col(low)[n])).alias(n) for n in totals))


def _floor_div(x: Column, by: Column) -> Column:
    """Whole-number division toward minus infinity."""
    return F.call_function("div", x - F.pmod(x, by), by)


def heavy_keys(df: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys of more than ``hot_rows`` rows and of more than 1 in ``HEAVY_KEYS`` of all rows.

    There are fewer than ``HEAVY_KEYS`` of them, whatever the table.  Null is none.
    """
    counts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("total"))
    least = F.greatest(F.lit(hot_rows), (total.scalar() / HEAVY_KEYS))
    return counts.filter(F.col("n") > least).select(key)


def split_join(
    left: DataFrame, right: DataFrame, key: str, how: str = "inner", hot_rows: int = HOT_ROWS, parts: int = 32
) -> DataFrame:
    """A join by ``key`` in which no task gets all left rows of a heavy key.

    Left rows of heavy keys are dealt to ``parts`` by their content, and right rows of these
    keys are repeated for each part; all other rows stay one part.  The result is that of the
    plain join, for "inner", "left", "left_semi" and "left_anti": a left row is in one part,
    and every part of its key has all right rows.  Null keys match nothing.  Left rows that are
    equal in all columns go together.  The heavy keys, fewer than ``HEAVY_KEYS``, are
    broadcast; nothing else is.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError("how is 'inner', 'left', 'left_semi' or 'left_anti'; other joins would repeat right rows")
    part, heavy, mark = (_unused(n, left, right) for n in ("split_part", "split_key", "split_mark"))
    keys = F.broadcast(heavy_keys(left, key, hot_rows).select(F.col(key).alias(heavy), F.lit(True).alias(mark)))
    deal = F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in left.columns)), F.lit(parts)).cast("int")
    ours = left.join(keys, left[key] == F.col(heavy), "left").withColumn(part, F.when(F.col(mark), deal).otherwise(0)).drop(heavy, mark)
    all_parts = F.array(*map(F.lit, range(parts)))
    theirs = right.join(keys, right[key] == F.col(heavy), "left")
    theirs = theirs.withColumn(part, F.explode(F.when(F.col(mark), all_parts).otherwise(F.array(F.lit(0))))).drop(heavy, mark)
    return ours.join(theirs, [key, part], how).drop(part)
