"""Rates, shards, capacity and cost: plain numbers, and the same over tables."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftloom.plans.spec import Spec

#: What a shard takes in a second, and a call at once.
SHARD_RECORDS, CALL_RECORDS = 1000, 500


def rates(spec: Spec) -> dict[str, float]:
    """Rows per second of each event type; empty in batch mode."""
    if spec.mode != "streaming":
        return {}
    total = sum(e.weight for e in spec.event_types)
    return {e.id: spec.rows_per_second * e.weight / total for e in spec.event_types}


def expected_rows(spec: Spec) -> dict[str, float]:
    """Rows of each event type to be expected in a batch."""
    total = sum(e.weight for e in spec.event_types)
    return {e.id: (spec.rows or 0) * e.weight / total for e in spec.event_types}


def spread(types: DataFrame, weight: str, total: float | Column, name: str) -> DataFrame:
    """A table of event types and weights with each type's share of ``total``: rows per second, or of a batch.

    Null weights have no share.
    """
    whole = types.agg(F.sum(weight)).scalar()
    return types.withColumn(name, total * F.col(weight) / whole)


def rates_table(spark: SparkSession, spec: Spec) -> DataFrame:
    return spark.createDataFrame(list(rates(spec).items()), "event_type string, rows_per_second double")


def shards(events_per_second: float) -> int:
    """Shards that a stream needs for its records."""
    return max(1, ceil(events_per_second / SHARD_RECORDS))


def shards_column(events_per_second: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(events_per_second / SHARD_RECORDS)).cast("int")


def cost_per_million(dollars_per_hour: Column, events_per_second: Column) -> Column:
    """Dollars for a million events at a sustained rate."""
    return dollars_per_hour / (events_per_second * 3600 / 1e6)


#: Shares above which a resource is the bottleneck.
CPU_HIGH, MEMORY_HIGH, GC_HIGH, NETWORK_HIGH = 0.80, 0.85, 0.10, 0.80


def action(metrics: dict[str, str] | None = None) -> Column:
    """What to do about a pipeline, from columns of its metrics.

    Shares are of 1: cpu_min (the idlest executor's), memory, gc, network; ``mixed``
    tells that stages differ.  backlog_growing decides whether anything needs doing.
    """
    c = {k: F.col((metrics or {}).get(k, k)) for k in ("backlog_growing", "cpu_min", "memory", "gc", "network", "mixed")}
    return (
        F.when(~c["backlog_growing"], "healthy")
        .when(c["mixed"], "split_pipeline")
        .when(c["cpu_min"] > CPU_HIGH, "scale_out")
        .when((c["memory"] > MEMORY_HIGH) | (c["gc"] > GC_HIGH), "scale_up")
        .when(c["network"] > NETWORK_HIGH, "optimize_shuffle")
        .otherwise("check_skew_source_sink_code")
    )


def breaking_point(steps: DataFrame, spare: float = 0.05) -> DataFrame:
    """Capacity from load steps (step, input_rate, processing_rate): one row.

    max_rate is the highest processing rate, capacity the highest input with at least
    ``spare`` headroom, breaking_rate the lowest input that wasn't kept up with.
    """
    headroom = (F.col("processing_rate") - F.col("input_rate")) / F.col("input_rate")
    return steps.agg(
        F.max("processing_rate").alias("max_rate"),
        F.max(F.when(headroom >= spare, F.col("input_rate"))).alias("capacity"),
        F.min(F.when(headroom < 0, F.col("input_rate"))).alias("breaking_rate"),
    )


def headroom_steps(steps: DataFrame) -> DataFrame:
    """Load steps with their headroom and how much of the added input the last step added to the output."""
    w = Window.orderBy("step")
    gained = (F.col("processing_rate") - F.lag("processing_rate").over(w)) / (F.col("input_rate") - F.lag("input_rate").over(w))
    return steps.withColumns(
        {"headroom": (F.col("processing_rate") - F.col("input_rate")) / F.col("input_rate"), "marginal": gained}
    )


def load_profile(spark: SparkSession, kind: str, seconds: int, base: float, peak: float, step: int = 1) -> DataFrame:
    """Input rate over time: second, rate.

    "baseline" stays at ``base``; "peak" at ``peak``; "burst" is at ``peak`` for the
    middle fifth; "soak" at nine tenths of ``peak``; "degradation" climbs from ``base``
    to ``peak`` and beyond by a half.
    """
    t, whole = F.col("second"), float(seconds)
    rate = {
        "baseline": F.lit(float(base)),
        "peak": F.lit(float(peak)),
        "burst": F.when((t >= 0.4 * whole) & (t < 0.6 * whole), float(peak)).otherwise(float(base)),
        "soak": F.lit(0.9 * peak),
        "degradation": F.lit(float(base)) + (1.5 * peak - base) * t / whole,
    }
    if kind not in rate:
        raise ValueError(f"unknown load profile {kind!r}; there are {', '.join(rate)}")
    return spark.range(0, seconds, step).select(F.col("id").alias("second"), rate[kind].alias("rate"))


def backlog(profile: DataFrame, capacity: float | Column, every: float = 1.0, keys: tuple[str, ...] = ()) -> DataFrame:
    """Backlog over a load at a fixed capacity: ``keys``, second, rate, backlog.

    ``profile`` has the rate of each step of ``every`` seconds, made or measured.  The
    backlog is the running sum of what is over capacity, less its lowest value so
    far: it never goes below nothing.  With ``keys`` each pipeline is one task's
    window; without, the steps are one series.
    """
    order = Window.partitionBy(*keys).orderBy("second").rowsBetween(Window.unboundedPreceding, 0)
    over = F.col("rate") - (capacity if isinstance(capacity, Column) else F.lit(float(capacity)))
    total = profile.withColumn("sum", F.sum(over * every).over(order))
    lowest = F.least(F.lit(0.0), F.min("sum").over(order))
    return total.select(*keys, "second", "rate", (F.col("sum") - lowest).alias("backlog"))
