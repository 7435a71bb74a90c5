"""Streams that keep state: interval joins, once-only delivery, and timers of keys.

State is in RocksDB, on disk with checkpoints in the query's folder, so it isn't bounded
by an executor's heap.  What leaves the state follows the watermark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from driftloom.sources.shared import shared_path
from driftloom.streaming.writers import write

_PROVIDER, _SHUFFLE = "spark.sql.streaming.stateStore.providerClass", "spark.sql.shuffle.partitions"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb_state(spark: SparkSession, few_groups: bool = False) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB, with ``few_groups`` in a partition per core at most.

    Each micro-batch loads and commits a store for each partition and stateful step, whatever is in it.
    """
    before = {k: spark.conf.get(k) for k in (_PROVIDER, _SHUFFLE)}
    spark.conf.set(_PROVIDER, _ROCKSDB)
    if few_groups:
        spark.conf.set(_SHUFFLE, min(int(before[_SHUFFLE]), spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        for k, value in before.items():
            spark.conf.set(k, value)


def replayed(spark: SparkSession, parts: list[DataFrame], query: Callable[[DataFrame], DataFrame], few_groups: bool = False) -> DataFrame:
    """What a stream's ``query`` has put out after ``parts`` of a table came one after another.

    Each part is written to a folder and the stream is started again from its checkpoint, until
    it has read all there is; so each restart has to find its state.  ``few_groups`` says that
    the state is of groups, far fewer than rows, and needs no more partitions than there are cores.
    """
    source, out, log = (shared_path(spark, n) for n in ("replay", "replay-out", "replay-log"))
    result = None
    for part in parts:
        part.write.mode("append").parquet(source)
        stream = query(spark.readStream.schema(part.schema).parquet(source))
        with rocksdb_state(spark, few_groups):
            started = write(stream, "parquet", out, checkpoint=log, trigger={"availableNow": True})
        started.awaitTermination()
        result = stream.schema
    return spark.read.schema(result).parquet(out)


def interval_join(
    left: DataFrame, right: DataFrame, keys: tuple[str, ...], left_time: str, right_time: str, within: str, watermark: str, how: str = "inner"
) -> DataFrame:
    """Rows of two streams of equal ``keys`` where the right one comes at most ``within`` later, not before.

    Both sides are state until the watermark tells that no partner can come any more: a left
    row for ``within`` and the watermark's delay, a right row for the delay.  With
    ``how="left"`` a left row without a partner comes out then, with nulls.  Null keys
    and null times match nothing.  Repeated rows join each for itself.  Apart from ``keys``, the
    sides have different column names.  Works on batches too, without the state.
    """
    if how not in ("inner", "left"):
        raise ValueError("how is 'inner' or 'left'")
    renamed = right.withColumnsRenamed({k: f"right_{k}" for k in keys})
    if left.isStreaming:
        left, renamed = left.withWatermark(left_time, watermark), renamed.withWatermark(right_time, watermark)
    on = (F.col(right_time) >= F.col(left_time)) & (F.col(right_time) <= F.col(left_time) + F.expr(f"INTERVAL {within}"))
    for k in keys:
        on = on & (F.col(k) == F.col(f"right_{k}"))
    return left.join(renamed, on, "leftOuter" if how == "left" else "inner").drop(*(f"right_{k}" for k in keys))


def once(stream: DataFrame, ids: tuple[str, ...], time: str, watermark: str) -> DataFrame:
    """Rows whose ``ids`` haven't come before, within the delay of the watermark.

    A copy counts as one if its time is less than the delay from the first row's; the state of
    an id ends when the watermark has passed its time and the delay.  Rows later than the
    watermark are dropped, copies or not.  Null ids are one id.
    """
    return stream.withWatermark(time, watermark).dropDuplicatesWithinWatermark(list(ids))


class _Silence(StatefulProcessor):
    """Keeps the times of a key until its silence after each is decided.

    A key has one timer, for the first of its times that no other one follows in time.  When it
    is due, all silences that the watermark has passed are told at once.
    """

    def __init__(self, millis: int) -> None:
        self.millis = millis

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getValueState("times", StructType([StructField("times", ArrayType(LongType()))]))

    def _known(self) -> list[int]:
        return list((self.times.get() or ([],))[0])

    def _silent(self, times: list[int]) -> Iterator[int]:
        """Those of the sorted times that none of them follows in time."""
        for time, after in zip(times, [*times[1:], None], strict=True):
            if after is None or after > time + self.millis:
                yield time

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        known = self._known()
        times = sorted({row.at for row in rows}.union(known))
        self.times.update((times,))
        # the timer that is there is due no later than the first silence that was known
        first = next(self._silent(times))
        if not known or first < next(self._silent(known)):
            self.handle.registerTimer(first + self.millis)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802, N803
        known = self._known()
        if not known:
            return
        # what is still to come isn't before the watermark, so it changes nothing that was due by then
        watermark = timerValues.getCurrentWatermarkInMs()
        passed = max(watermark, expiredTimerInfo.getExpiryTimeInMs() + 1)
        silent = list(self._silent(known))
        open_ = [t for t in silent if t + self.millis >= passed]
        left = sorted({t for t in known if t >= watermark and t + self.millis >= passed}.union(open_))
        if left:
            self.times.update((left,))
            self.handle.registerTimer(next(self._silent(left)) + self.millis)
        else:
            self.times.clear()
        for time in silent:
            if time + self.millis < passed:
                yield Row(key=key[0], last=time, due=time + self.millis)

    def close(self) -> None:
        pass


def silences(stream: DataFrame, key: str, time: str, minutes: int, watermark: str) -> DataFrame:
    """Times at which a ``key`` has been silent for ``minutes``: key, last_seen, silent_at.

    A timer of event time is set for a key's first row that none is known to follow in time, and tells
    when the watermark has passed it whether one came until then (one at the very end counts),
    for all rows that the watermark has passed by ``minutes``.  Rows in any order
    within the watermark's delay give the same result, as the state holds all times that
    aren't decided or may still follow one, ``minutes`` and the delay at most.  Times are in milliseconds.  Null
    keys are a key; rows with a null time are left out.  Of equal times one counts.
    """
    kind = stream.schema[key].dataType
    rows = stream.filter(F.col(time).isNotNull()).withWatermark(time, watermark)
    rows = rows.select(F.col(key).alias("key"), F.unix_millis(F.col(time)).alias("at"), time)
    out = StructType([StructField("key", kind), StructField("last", LongType()), StructField("due", LongType())])
    told = rows.groupBy("key").transformWithState(_Silence(minutes * 60_000), out, "Append", "EventTime")
    return told.select(F.col("key").alias(key), F.timestamp_millis("last").alias("last_seen"), F.timestamp_millis("due").alias("silent_at"))
