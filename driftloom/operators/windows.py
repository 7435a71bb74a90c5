"""Sliding windows from panes, and sessions, for batches and streams alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _merged(states: Column) -> Column:
    """Panes' states as one: n, mean, m2 (sum of squared distances from the mean), low, high.

    Means are merged pairwise, which stays exact enough where they are large beside the spread.
    """
    none = F.struct(
        F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"),
        F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"),
    )

    def merge(a: Column, b: Column) -> Column:
        n, gap = a["n"] + b["n"], b["mean"] - a["mean"]
        both = F.struct(
            n.alias("n"),
            (a["mean"] + gap * b["n"] / n).alias("mean"),
            (a["m2"] + b["m2"] + gap * gap * a["n"] * b["n"] / n).alias("m2"),
            F.least(a["low"], b["low"]).alias("low"),
            F.greatest(a["high"], b["high"]).alias("high"),
        )
        return F.when(b["n"] == 0, a).when(a["n"] == 0, b).otherwise(both)

    return F.aggregate(states, none, merge)


def sliding(
    events: DataFrame, time: str, keys: tuple[str, ...], measure: str, length: str, slide: str, watermark: str | None = None
) -> DataFrame:
    """Statistics of ``measure`` in windows of ``length`` that begin every ``slide``, per ``keys``.

    Rows are aggregated once, into panes of ``slide``; windows are merged from their panes, so
    what is repeated for each window is a pane's state and never a row.  A pane lies in
    as many windows as ``slide`` goes into ``length``, rounded up; ``length`` should be a
    multiple of ``slide``, as windows are made of whole panes.

    Columns: window_start, window_end, ``keys``, event_count (of all rows), and avg, min,
    max and stddev of ``measure``, whose nulls count as rows only; stddev is null below two
    values.  Rows with a null time are in no window.  A stream needs a watermark and append mode.
    """
    source = events.withWatermark(time, watermark) if watermark else events
    value = F.col(measure).cast("double")
    n = F.count(value)
    state = F.struct(
        n.alias("n"), F.coalesce(F.avg(value), F.lit(0.0)).alias("mean"), F.coalesce(F.var_pop(value) * n, F.lit(0.0)).alias("m2"),
        F.min(value).alias("low"), F.max(value).alias("high"),
    )
    panes = source.groupBy(F.window(time, slide).alias("pane"), *keys).agg(F.count("*").alias("rows"), state.alias("state"))
    whole = F.window(F.window_time("pane"), length, slide).alias("window")
    out = panes.groupBy(whole, *keys).agg(F.sum("rows").alias("event_count"), F.collect_list("state").alias("states"))
    out = out.withColumn("s", _merged(F.col("states")))
    some = lambda c, least=1: F.when(F.col("s.n") >= least, c)
    return out.select(
        F.col("window.start").alias("window_start"),
        F.col("window.end").alias("window_end"),
        *keys,
        "event_count",
        some(F.col("s.mean")).alias(f"avg_{measure}"),
        F.col("s.low").alias(f"min_{measure}"),
        F.col("s.high").alias(f"max_{measure}"),
        some(F.sqrt(F.col("s.m2") / (F.col("s.n") - 1)), 2).alias(f"stddev_{measure}"),
    )


def sessions(events: DataFrame, time: str, keys: tuple[str, ...], gap: str, measure: str | None = None, watermark: str | None = None) -> DataFrame:
    """Sessions per ``keys``: rows of which each is at most ``gap`` after the one before.

    Columns: session_start, session_end (``gap`` after the last row), ``keys``,
    event_count, and with ``measure`` its sum.  A distance of just ``gap`` goes on with the
    session.  Null keys are a key; rows with a null time are in no session.  Spark keeps one
    merging state for each session, not its rows.  A stream needs a watermark and append
    mode: a session comes out when the watermark has passed its end.
    """
    source = events.filter(F.col(time).isNotNull())
    source = source.withWatermark(time, watermark) if watermark else source
    stats = [F.count("*").alias("event_count")] + ([F.sum(measure).alias(f"sum_{measure}")] if measure else [])
    out = source.groupBy(F.session_window(time, gap).alias("session"), *keys).agg(*stats)
    return out.select(F.col("session.start").alias("session_start"), F.col("session.end").alias("session_end"), *keys, *out.columns[1 + len(keys) :])
