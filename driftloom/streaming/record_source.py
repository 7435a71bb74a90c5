"""A partitioned reader of record streams, for ``readStream.format("driftloom_records")``.

A shard is a partition.  Offsets are arrival times per shard, in milliseconds: a batch is what
arrived in a span of time, so a batch that is read again after a failure is the same, and a
query that starts again from its checkpoint reads nothing twice and leaves nothing out.
``start`` is "earliest" (the default), "latest", or a time; ``batch_seconds`` bounds
the span of a batch; records of the last ``settle_seconds`` (1) wait for the next batch, as they may
still be arriving.  Shards that come up later are read from their beginning on.

The client is that of the sink: list_shards, get_shard_iterator and get_records.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from datetime import datetime, timezone
from typing import Any

import pyarrow as pa
from pyspark.sql.datasource import DataSourceStreamReader, InputPartition

#: Fixed value of the service: records of an answer at most.
ANSWER_RECORDS = 10_000
ARROW = pa.schema(
    [("partition_key", pa.string()), ("data", pa.string()), ("sequence_number", pa.string()), ("shard", pa.string()), ("arrived", pa.timestamp("us", "UTC"))]
)


def _millis(start: str, now: int) -> int:
    if start == "earliest":
        return 0
    if start == "latest":
        return now
    at = datetime.fromisoformat(start)
    return round((at if at.tzinfo else at.replace(tzinfo=timezone.utc)).timestamp() * 1000)


class ShardSpan(InputPartition):
    """What arrived at a shard from ``begin`` on and before ``end``, in milliseconds."""

    def __init__(self, shard: str, begin: int, end: int) -> None:
        self.shard, self.begin, self.end = shard, begin, end


class RecordStreamReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str], client: Callable[[dict], Any]) -> None:
        self.options = dict(options)
        self.stream_name = options.get("stream_name")
        if not self.stream_name:
            raise ValueError("stream_name is required")
        self.client = client
        self.start = str(options.get("start", "earliest"))
        self.span = round(1000 * float(options["batch_seconds"])) if options.get("batch_seconds") else None
        self.settle = round(1000 * float(options.get("settle_seconds", 1)))
        self.reached: dict[str, int] = {}
        _millis(self.start, 0)

    def _shards(self) -> list[str]:
        client, out, more = self.client(self.options), [], {"StreamName": self.stream_name}
        while True:
            said = client.list_shards(**more)
            out += [s["ShardId"] for s in said.get("Shards", [])]
            if not said.get("NextToken"):
                return sorted(out)
            more = {"NextToken": said["NextToken"]}

    def _first_arrival(self, shard: str, begin: int) -> int | None:
        """When the shard's first record from ``begin`` on arrived."""
        for record in self._records(shard, begin, limit=1):
            return record[0]
        return None

    def initialOffset(self) -> dict:  # noqa: N802
        now = round(time.time() * 1000)
        self.reached = {s: _millis(self.start, now) for s in self._shards()}
        return dict(self.reached)

    def latestOffset(self) -> dict:  # noqa: N802
        until = round(time.time() * 1000) - self.settle
        out = {}
        for shard in self._shards():
            begin = self.reached.get(shard, 0)
            end = max(begin, until)
            if self.span is not None and end - begin > self.span:
                # a quiet time is passed over: the span begins where the next record is
                first = self._first_arrival(shard, begin)
                end = end if first is None else min(end, max(begin, first) + self.span)
            out[shard] = end
        self.reached = self.reached | out
        return out

    def partitions(self, start: dict, end: dict) -> list[ShardSpan]:
        # after a restart the query says from where on
        self.reached = {s: max(self.reached.get(s, 0), t) for s, t in end.items()}
        return [ShardSpan(s, start.get(s, 0), t) for s, t in end.items() if t > start.get(s, 0)]

    def _records(self, shard: str, begin: int, limit: int = ANSWER_RECORDS) -> Iterator[tuple[int, dict]]:
        client = self.client(self.options)
        where: dict[str, Any] = {"ShardIteratorType": "TRIM_HORIZON"}
        if begin:
            where = {"ShardIteratorType": "AT_TIMESTAMP", "Timestamp": datetime.fromtimestamp(begin / 1000, timezone.utc)}
        at = client.get_shard_iterator(StreamName=self.stream_name, ShardId=shard, **where)["ShardIterator"]
        while at:
            said = client.get_records(ShardIterator=at, Limit=limit)
            for record in said["Records"]:
                arrived = round(record["ApproximateArrivalTimestamp"].timestamp() * 1000)
                if arrived >= begin:
                    yield arrived, record
            at = said.get("NextShardIterator")
            if not said["Records"] and not said.get("MillisBehindLatest"):
                return

    def read(self, partition: ShardSpan) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for arrived, record in self._records(partition.shard, partition.begin):
            if arrived >= partition.end:
                break
            data = record["Data"]
            rows.append(
                {
                    "partition_key": record["PartitionKey"], "data": data.decode() if isinstance(data, bytes) else data,
                    "sequence_number": record["SequenceNumber"], "shard": partition.shard, "arrived": datetime.fromtimestamp(arrived / 1000, timezone.utc),
                }
            )
            if len(rows) >= ANSWER_RECORDS:
                yield pa.RecordBatch.from_pylist(rows, ARROW)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, ARROW)

    def commit(self, end: dict) -> None:
        """Nothing: the query's checkpoint holds the offsets."""
