"""Progress of streaming queries as rows."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.query import StreamingQuery

SCHEMA = "batch long, input_rows long, input_rate double, processing_rate double, batch_seconds double"


def _row(p: dict) -> tuple:
    return (
        int(p["batchId"]),
        int(p["numInputRows"]),
        float(p.get("inputRowsPerSecond") or 0.0),
        float(p.get("processedRowsPerSecond") or 0.0),
        float((p.get("durationMs") or {}).get("triggerExecution", 0)) / 1000,
    )


def progress(query: StreamingQuery) -> DataFrame:
    """The query's recent micro-batches: batch, input_rows, input_rate, processing_rate, batch_seconds."""
    spark = SparkSession.getActiveSession()
    return spark.createDataFrame([_row(json.loads(p.json) if hasattr(p, "json") else p) for p in query.recentProgress], SCHEMA)


class ProgressLog(StreamingQueryListener):
    """Keeps the last ``size`` progress rows of each query, all of them where that is None.

    ``with ProgressLog(spark) as log:`` listens to the queries that start inside;
    ``log.progress(query)`` has all their micro-batches, whereas a query itself keeps its
    last hundred only.
    """

    def __init__(self, spark: SparkSession | None = None, size: int | None = None) -> None:
        self.spark, self.size = spark, size
        self.rows: dict[str, list[tuple]] = {}

    def __enter__(self) -> ProgressLog:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *_: object) -> None:
        self.spark.streams.removeListener(self)

    def progress(self, query: StreamingQuery, wait_seconds: float = 30) -> DataFrame:
        """Its micro-batches, once the listener has heard of the last one that the query knows."""
        run, until = str(query.runId), time.monotonic() + wait_seconds
        last = query.lastProgress
        while last and not any(r[0] == int(last["batchId"]) for r in self.rows.get(run, [])) and time.monotonic() < until:
            time.sleep(0.05)
        return self.spark.createDataFrame(self.rows.get(run, []), SCHEMA)

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        said = json.loads(event.progress.json)
        known = self.rows.setdefault(said["runId"], [])
        known.append(_row(said))
        if self.size is not None:
            del known[: -self.size]

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass
