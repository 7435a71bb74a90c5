"""What consumers of the events ask of them.  Each function is one DataFrame to another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftloom.sources.shared import checkpointed


def parse(envelopes: DataFrame, time: str = "event_timestamp", data: str = "data", keep: tuple[str, ...] = ()) -> DataFrame:
    """event_name, event_id, event key and time from a payload, which is parsed once."""
    text = F.col(data).cast("string")
    names = ("event_name", "event_key", "event_id")
    kind = ", ".join(f"`{n}` string" for n in (*names, time))
    said = envelopes.select(*keep, F.from_json(text, kind).alias("said"), text.alias("payload"))
    return said.select(*keep, *(F.col(f"said.{n}").alias(n) for n in names), F.to_timestamp(F.col("said")[time]).alias(time), "payload")


def latency_seconds(later: Column, earlier: Column) -> Column:
    """Whole seconds between two times."""
    return F.unix_timestamp(later) - F.unix_timestamp(earlier)


def with_latency(events: DataFrame, created: str, arrived: str, read: str) -> DataFrame:
    """e2e_latency_seconds (read after created) and arrival_latency_seconds (read after arrived)."""
    return events.withColumns(
        {
            "e2e_latency_seconds": latency_seconds(F.col(read), F.col(created)),
            "arrival_latency_seconds": latency_seconds(F.col(read), F.col(arrived)),
        }
    )


def windowed(
    events: DataFrame, time: str, keys: tuple[str, ...], measures: tuple[str, ...], length: str = "10 seconds",
    slide: str | None = None, watermark: str | None = "30 seconds",
) -> DataFrame:
    """Count, average, extremes and standard deviation per window and keys."""
    source = events.withWatermark(time, watermark) if watermark else events
    window = F.window(time, length, slide) if slide else F.window(time, length)
    stats = [F.count("*").alias("event_count")]
    for m in measures:
        for name in ("avg", "min", "max", "stddev"):
            stats.append(getattr(F, name)(m).alias(f"{name}_{m}"))
    grouped = source.groupBy(window, *keys).agg(*stats)
    return grouped.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *grouped.columns[1:])


def latest_first(windows: DataFrame) -> DataFrame:
    return windows.orderBy(F.desc("window_start"))


def percentiles(
    events: DataFrame, measure: str, keys: tuple[str, ...] = (), at: tuple[float, ...] = (0.5, 0.95, 0.99), exact: bool = False
) -> DataFrame:
    """p50, p95, p99 and the like.

    The approximate ones need bounded memory per group; their ranks are off by 1 in 10,000
    of a group's rows at most.  The exact ones keep a count of each distinct value.
    """
    how = F.percentile if exact else F.percentile_approx
    return events.groupBy(*keys).agg(*(how(measure, F.lit(p)).alias(f"p{round(100 * p):02d}") for p in at))


def distribution(events: DataFrame, key: str, weights: dict[str, int] | None = None) -> DataFrame:
    """Rows and share per key, and the share that weights configure."""
    counts = events.groupBy(key).agg(F.count("*").alias("rows"))
    # the total is the sum of the keys' counts, whose exchange is used again: one scan
    out = counts.withColumn("share", F.col("rows") / counts.agg(F.sum("rows")).scalar())
    if weights:
        total, expected = float(sum(weights.values())), None
        for k, w in weights.items():
            expected = F.when(F.col(key) == k, w / total) if expected is None else expected.when(F.col(key) == k, w / total)
        out = out.withColumn("expected", expected.otherwise(0.0))
        out = out.withColumn("gap", F.col("share") - F.col("expected"))
    return out


def skew(events: DataFrame, key: str) -> DataFrame:
    """How uneven keys are: keys, rows, the largest key's, the average, and their ratio."""
    counts = events.groupBy(key).agg(F.count("*").alias("n"))
    return counts.agg(
        F.count("*").alias("keys"),
        F.sum("n").alias("rows"),
        F.max("n").alias("largest"),
        F.avg("n").alias("average"),
        (F.max("n") / F.avg("n")).alias("ratio"),
    )


def fan_out(names: DataFrame, column: str, block: int = 50) -> DataFrame:
    """Names in blocks of ``block``, in order: name, pipeline.

    The distinct names are ranked in ranges, so that no task sees all of them.  The ranges
    are kept in the shared folder, as their sizes and their rows are two readings.
    """
    distinct = names.select(column).distinct()
    ranged = checkpointed(distinct.repartitionByRange(column).select(column, F.spark_partition_id().alias("part")))
    sizes = ranged.groupBy("part").agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = F.row_number().over(Window.partitionBy("part").orderBy(column)) - 1
    return ranged.withColumn("own", own).join(bases, "part").select(column, F.floor((F.col("base") + F.col("own")) / block).cast("int").alias("pipeline"))


def only(events: DataFrame, key: str, types: tuple[str, ...]) -> DataFrame:
    """The rows of some event types."""
    return events.filter(F.col(key).isin(*types))


def health(progress: DataFrame, trigger_seconds: float) -> DataFrame:
    """Progress rows (input_rate, processing_rate, batch_seconds) with what is wrong with them."""
    state = (
        F.when(F.col("processing_rate") < F.col("input_rate"), "backlog_growing")
        .when(F.col("batch_seconds") > trigger_seconds, "over_trigger")
        .when(F.col("batch_seconds") > 0.8 * trigger_seconds, "near_trigger")
        .otherwise("healthy")
    )
    return progress.withColumn("state", state)
