"""A sink for keyed records, as a Python data source for batches and streams.

Rows have ``partition_key`` and ``data``.  Records go out in calls of at most 500; rows
whose key or data is null are skipped and counted.  By default a failed record is
counted and the batch still commits (at most once per record); with ``retries`` only
the failed records of a call are sent again after ``retry_seconds`` (0.1), then twice as
long each time; with ``fail_on_error`` a task fails for what is left.  An answer that
counts failures but doesn't tell them is counted and not sent again.

Writers get Arrow batches and work on whole columns; calls go out of a bounded queue as soon
as a thread is free.  The same source reads records, see ``record_source``.
"""

from __future__ import annotations

import importlib
import logging
import time
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from dataclasses import dataclass
from itertools import islice
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Row
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceStreamArrowWriter,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from driftloom.streaming.record_source import RecordStreamReader

log = logging.getLogger(__name__)

#: Fixed values of the service: records of a call; threads of a task.
CALL_RECORDS, THREADS = 500, 50


@dataclass
class Sent(WriterCommitMessage):
    """What one task sent."""

    sent: int = 0
    failed: int = 0
    skipped: int = 0


def stream_client(options: dict[str, str]) -> Any:
    """A Kinesis client: service credential, else static keys, else the ambient ones.

    ``client_factory`` names another one, "module:function", that gets the options.
    """
    factory = options.get("client_factory")
    if factory:
        module, _, name = factory.partition(":")
        return getattr(importlib.import_module(module), name)(options)
    try:
        import boto3
    except ImportError as error:
        raise ImportError("this sink needs boto3, or a client_factory of your own") from error
    region = options.get("region", "us-east-1")
    pool: dict[str, Any] = {}
    try:
        from botocore.config import Config

        # as many kept connections as a task has threads
        pool = {"config": Config(max_pool_connections=THREADS, tcp_keepalive=True)}
    except ImportError:
        log.debug("no botocore: the client's own pool of connections is used")
    provider = options.get("credential_provider")
    if options.get("service_credential"):
        if not provider:
            raise ValueError("service_credential needs credential_provider, 'module:function' that returns a session")
        module, _, name = provider.partition(":")
        return getattr(importlib.import_module(module), name)(options["service_credential"]).client("kinesis", region_name=region, **pool)
    keys = {k: options[k] for k in ("aws_access_key_id", "aws_secret_access_key", "aws_session_token") if options.get(k)}
    return boto3.client("kinesis", region_name=region, **keys, **pool)


class _Writer:
    """Shared by the batch and the stream writer; pickled to the executors."""

    def __init__(self, options: dict[str, str], client: Callable[[dict], Any] = stream_client) -> None:
        self.options = dict(options)
        self.stream_name = options.get("stream_name")
        if not self.stream_name:
            raise ValueError("stream_name is required")
        if bool(options.get("aws_access_key_id")) != bool(options.get("aws_secret_access_key")):
            raise ValueError("aws_access_key_id and aws_secret_access_key are required together")
        self.retries = int(options.get("retries", 0))
        self.pause = float(options.get("retry_seconds", 0.1))
        self.fail_on_error = str(options.get("fail_on_error", "false")).lower() == "true"
        self.client = client

    def records(self, items: Iterable[pa.RecordBatch | Row], message: Sent) -> Iterator[dict]:
        for item in items:
            batch = item if isinstance(item, pa.RecordBatch) else pa.RecordBatch.from_pylist([item.asDict()])
            data, key = (batch.column(n) if n in batch.schema.names else pa.nulls(batch.num_rows) for n in ("data", "partition_key"))
            if pa.types.is_string(data.type) or pa.types.is_large_string(data.type):
                data = data.cast(pa.large_binary())
            good = pc.and_(pc.is_valid(data), pc.is_valid(key))
            message.skipped += batch.num_rows - (pc.sum(good).as_py() or 0)
            for d, k in zip(data.filter(good).to_pylist(), key.filter(good).cast(pa.string()).to_pylist(), strict=True):
                yield {"Data": d if isinstance(d, bytes) else str(d).encode(), "PartitionKey": k}

    def send(self, client: Any, chunk: list[dict]) -> tuple[int, int]:
        """Sent and failed records of a call."""
        left = chunk
        for attempt in range(self.retries + 1):
            if attempt:
                time.sleep(self.pause * 2 ** (attempt - 1))
            try:
                said = client.put_records(StreamName=self.stream_name, Records=left)
            except Exception as error:
                log.warning("a call of %d records failed: %s", len(left), error)
                continue
            if not said.get("FailedRecordCount"):
                return len(chunk), 0
            answers = said.get("Records", [])
            codes = Counter(a["ErrorCode"] for a in answers if a.get("ErrorCode"))
            log.warning("%d records failed: %s", said["FailedRecordCount"], dict(codes))
            failed = [r for r, a in zip(left, answers, strict=False) if a.get("ErrorCode")]
            if not failed:
                left = left[: said["FailedRecordCount"]]  # which ones isn't known: only their number counts
                break
            left = failed
        return len(chunk) - len(left), len(left)

    def write(self, iterator: Iterator[pa.RecordBatch | Row]) -> Sent:
        message, client = Sent(), self.client(self.options)
        records = self.records(iterator, message)
        pending: set[Future] = set()

        def count(done: set[Future]) -> None:
            for call in done:
                sent, failed = call.result()
                message.sent += sent
                message.failed += failed

        with ThreadPoolExecutor(THREADS) as pool:
            # two calls a thread wait or run at a time: a partition isn't held in memory, and no call waits for a slow one
            while call := list(islice(records, CALL_RECORDS)):
                if len(pending) >= 2 * THREADS:
                    done, pending = wait(pending, return_when=FIRST_COMPLETED)
                    count(done)
                pending.add(pool.submit(self.send, client, call))
            count(pending)
        if message.failed and self.fail_on_error:
            raise RuntimeError(f"{message.failed} of {message.sent + message.failed} records failed")
        return message

    @staticmethod
    def total(messages: list[WriterCommitMessage | None]) -> Sent:
        known = [m for m in messages if m is not None]
        return Sent(sum(m.sent for m in known), sum(m.failed for m in known), sum(m.skipped for m in known))


class RecordStreamWriter(_Writer, DataSourceStreamArrowWriter):
    def commit(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:
        total = self.total(messages)
        log.info("batch %d: sent %d, failed %d, skipped %d", batchId, total.sent, total.failed, total.skipped)

    def abort(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:
        log.error("batch %d was aborted; %d records had been sent", batchId, self.total(messages).sent)


class RecordBatchWriter(_Writer, DataSourceArrowWriter):
    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        total = self.total(messages)
        log.info("sent %d, failed %d, skipped %d", total.sent, total.failed, total.skipped)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        log.error("the write was aborted; %d records had been sent", self.total(messages).sent)


class RecordSink(DataSource):
    """``format("driftloom_records")``; register with ``spark.dataSource.register(RecordSink)``."""

    @classmethod
    def name(cls) -> str:
        return "driftloom_records"

    def schema(self) -> str:
        return "partition_key string, data string, sequence_number string, shard string, arrived timestamp"

    def writer(self, schema: StructType, overwrite: bool) -> RecordBatchWriter:
        return RecordBatchWriter(self.options)

    def streamWriter(self, schema: StructType, overwrite: bool) -> RecordStreamWriter:
        return RecordStreamWriter(self.options)

    def streamReader(self, schema: StructType) -> RecordStreamReader:  # noqa: N802
        return RecordStreamReader(self.options, stream_client)


KinesisDataSource = RecordSink
