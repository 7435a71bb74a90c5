"""Record streams read from their shards, sinks of Arrow batches, documents by the table, and plans of the analytics."""

import json
import time
from datetime import datetime, timezone

import pyarrow as pa
import pytest
from driftloom.operators import analytics, envelope
from driftloom.plans.documents import check_documents, read_documents
from driftloom.streaming import record_files
from driftloom.streaming.monitor import ProgressLog
from driftloom.streaming.record_sink import RecordBatchWriter, RecordSink, Sent
from driftloom.streaming.record_source import RecordStreamReader
from driftloom.streaming.writers import route, write
from pyspark.sql import functions as F

SENT = {"stream_name": "s", "client_factory": record_files.FACTORY}


def send(spark, path, ids, shards=3):
    rows = spark.createDataFrame([(f"k{i % 7}", f"d{i}") for i in ids], "partition_key string, data string")
    write(rows, RecordSink.name(), records_path=path, records_shards=str(shards), **SENT)
    time.sleep(0.02)


def read(spark, path, tmp_path, name="out", shards=3, **options):
    stream = spark.readStream.format(RecordSink.name()).options(records_path=path, records_shards=str(shards), settle_seconds="0", **SENT, **options).load()
    query = write(stream, "parquet", str(tmp_path / name), checkpoint=str(tmp_path / f"{name}-log"), trigger={"availableNow": True})
    query.awaitTermination()
    return query


def test_restart_reads_nothing_twice(spark, tmp_path):
    spark.dataSource.register(RecordSink)
    path = f"file://{tmp_path}/records"
    for k in range(3):
        send(spark, path, range(k * 40, k * 40 + 40))
        read(spark, path, tmp_path)
    read(spark, path, tmp_path)
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(r.data for r in rows) == sorted(f"d{i}" for i in range(120))
    assert len({r.sequence_number for r in rows}) == 120 and len({(r.partition_key, r.shard) for r in rows}) == 7
    assert all(r.arrived is not None for r in rows)


def test_start_positions(spark, tmp_path):
    spark.dataSource.register(RecordSink)
    path = f"file://{tmp_path}/records"
    send(spark, path, range(10))
    now = datetime.now(timezone.utc)
    time.sleep(0.02)
    send(spark, path, range(10, 15))
    read(spark, path, tmp_path, "since", start=now.isoformat())
    assert sorted(r.data for r in spark.read.parquet(str(tmp_path / "since")).collect()) == sorted(f"d{i}" for i in range(10, 15))
    read(spark, path, tmp_path, "latest", start="latest")
    assert spark.read.schema("data string").parquet(str(tmp_path / "latest")).count() == 0
    send(spark, path, [99])
    read(spark, path, tmp_path, "latest", start="latest")
    assert [r.data for r in spark.read.parquet(str(tmp_path / "latest")).collect()] == ["d99"]
    with pytest.raises(ValueError):
        RecordStreamReader({"stream_name": "s", "start": "yesterday"}, record_files.client)
    with pytest.raises(ValueError, match="stream_name"):
        RecordStreamReader({}, record_files.client)


def test_spans_are_bounded_and_repeatable(tmp_path):
    path = f"file://{tmp_path}/records"
    client = record_files.client({"records_path": path})
    for i in range(4):
        client.put_records("s", [{"PartitionKey": "k", "Data": f"d{i}".encode()}] * 3)
        time.sleep(0.03)
    reader = RecordStreamReader(SENT | {"records_path": path, "batch_seconds": "0.02", "settle_seconds": "0"}, record_files.client)
    at, batches = reader.initialOffset(), []
    for _ in range(20):
        end = reader.latestOffset()
        got = [[r["data"] for p in reader.partitions(at, end) for b in reader.read(p) for r in b.to_pylist()] for _ in range(2)]
        assert got[0] == got[1]
        batches.append(got[0])
        at = end
    assert [x for b in batches for x in b] == [f"d{i}" for i in range(4) for _ in range(3)]
    assert max(map(len, batches)) == 3


def test_answers_are_bounded(tmp_path):
    client = record_files.client({"records_path": f"file://{tmp_path}/records"})
    client.put_records("s", [{"PartitionKey": "k", "Data": str(i).encode()} for i in range(25)])
    time.sleep(0.005)  # files of one millisecond are in no order
    client.put_records("s", [{"PartitionKey": "k", "Data": str(i).encode()} for i in range(25, 30)])
    at, sizes, seen = client.get_shard_iterator("", "TRIM_HORIZON")["ShardIterator"], [], []
    while True:
        said = client.get_records(at, 10)
        if not said["Records"]:
            break
        sizes.append(len(said["Records"]))
        seen += [int(r["Data"]) for r in said["Records"]]
        at = said["NextShardIterator"]
    assert max(sizes) == 10 and seen == sorted(seen) == list(range(30))


def test_answers_that_end_within_a_later_file_leave_nothing_out(tmp_path):
    client = record_files.client({"records_path": f"file://{tmp_path}/records"})
    for first in (0, 7):
        client.put_records("s", [{"PartitionKey": "k", "Data": str(i).encode()} for i in range(first, 25)])
        time.sleep(0.005)
    at, seen = client.get_shard_iterator("", "TRIM_HORIZON")["ShardIterator"], []
    while (said := client.get_records(at, 10))["Records"]:
        seen += [int(r["Data"]) for r in said["Records"]]
        at = said["NextShardIterator"]
    assert seen == [*range(25), *range(7, 25)]


def test_writers_take_whole_columns():
    calls = []

    class Client:
        def put_records(self, StreamName, Records):  # noqa: N803
            calls.append(Records)
            return {"FailedRecordCount": 0}

    batches = [
        pa.RecordBatch.from_pydict({"data": ["é", None, "c"], "partition_key": [1, 2, None], "more": [0, 0, 0]}),
        pa.RecordBatch.from_pydict({"data": pa.array([b"\xff", b""], pa.binary()), "partition_key": ["x", "y"]}),
        pa.RecordBatch.from_pydict({"data": ["no key"]}),
    ]
    sent = RecordBatchWriter({"stream_name": "s"}, lambda _: Client()).write(iter(batches))
    assert sent == Sent(3, 0, 3)
    assert [(r["PartitionKey"], r["Data"]) for c in calls for r in c] == [("1", "é".encode()), ("x", b"\xff"), ("y", b"")]


def test_client_keeps_a_connection_for_each_thread(monkeypatch):
    import sys
    from types import ModuleType

    from driftloom.streaming.record_sink import THREADS, stream_client

    made = []
    boto3, botocore, config = ModuleType("boto3"), ModuleType("botocore"), ModuleType("botocore.config")
    config.Config = lambda **k: k
    boto3.client = lambda kind, **k: made.append((kind, k)) or "client"
    for name, module in (("boto3", boto3), ("botocore", botocore), ("botocore.config", config)):
        monkeypatch.setitem(sys.modules, name, module)
    assert stream_client({"stream_name": "s"}) == "client"
    assert made == [("kinesis", {"region_name": "us-east-1", "config": {"max_pool_connections": THREADS, "tcp_keepalive": True}})]


def test_slow_calls_do_not_hold_up_others():
    """One call takes long; all others are done by then."""
    done = []

    class Client:
        def put_records(self, StreamName, Records):  # noqa: N803
            if Records[0]["Data"] == b"0":
                time.sleep(0.6)
            done.append(Records[0]["Data"])
            return {"FailedRecordCount": 0}

    batch = pa.RecordBatch.from_pydict({"data": [str(i) for i in range(90_000)], "partition_key": ["k"] * 90_000})
    assert RecordBatchWriter({"stream_name": "s"}, lambda _: Client()).write(iter([batch])).sent == 90_000
    assert done.index(b"0") > 150


def test_log_has_all_batches(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.range(0, 120, 1, 120).write.parquet(path)
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(path)
    with ProgressLog(spark) as log:
        query = write(stream, "noop", checkpoint=str(tmp_path / "log"), trigger={"availableNow": True})
        query.awaitTermination()
        rows = log.progress(query).filter("input_rows > 0").collect()
    assert sum(r.input_rows for r in rows) == 120 and len(rows) > 100 >= len(query.recentProgress)


def test_failing_sink_leaves_nothing_cached(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.range(3).selectExpr("id", "'a' AS kind").write.parquet(path)

    def sink(df, name):
        raise OSError("full")

    query = route(spark.readStream.schema("id long, kind string").parquet(path), "kind", {"one": ("a",)}, sink)
    with pytest.raises(Exception, match="full"):
        query.awaitTermination()
    assert spark.sparkContext._jsc.sc().getPersistentRDDs().isEmpty()


def test_documents(spark):
    good = {"generation_mode": "batch", "batch_config": {"total_rows": 1}, "sink_config": {"type": "x"}, "event_types": [{"event_type_id": "a", "weight": 1}]}
    texts = [json.dumps(good), "generation_mode: batch\nbatch_config: {total_rows: 1}\nsink_config: {type: x}\nevent_types: [{event_type_id: a, weight: 1}]"]
    texts += [None, "", "[1]", "{", "a: [", json.dumps(good | {"event_types": []})]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    rows = {r.i: r for r in check_documents(df, "text").collect()}
    assert [rows[i].valid for i in range(8)] == [True, True] + [False] * 6
    assert all((rows[i].error is None) == rows[i].valid for i in range(8))
    read = {r.i: r for r in read_documents(df, "text", {"mode": "generation_mode", "n": "batch_config.total_rows", "none": "a.b"}).collect()}
    assert [(read[i].mode, read[i].n, read[i].none) for i in (0, 1, 2)] == [("batch", "1", None), ("batch", "1", None), (None, None, None)]
    assert check_documents(df.limit(0), "text").count() == 0
    with pytest.raises(ValueError, match="already"):
        check_documents(df.withColumn("Valid", F.lit(1)), "text")


def test_payload_is_parsed_once(spark):
    df = spark.createDataFrame([('{"event_name": "a", "event_id": 7, "k": 1.50, "event_timestamp": "2024-01-01T00:00:00.5Z"}',), ("no json",), (None,)], "data string")
    parsed = analytics.parse(df)
    assert [(r.event_name, r.event_id, r.event_key) for r in parsed.collect()] == [("a", "7", None), (None, None, None), (None, None, None)]
    physical = lambda d: d._jdf.queryExecution().executedPlan().toString()
    assert physical(parsed).count("from_json") == 1 and "get_json_object" not in physical(parsed)
    picked = envelope.extract(df, {"k": "double", "event_id": "int"})
    assert [tuple(r) for r in picked.collect()] == [(1.5, 7), (None, None), (None, None)]
    assert physical(picked).count("from_json") == 1


def test_distribution_reads_its_table_once(spark, tmp_path):
    spark.range(100).selectExpr("id % 4 AS k").write.parquet(str(tmp_path / "t"))
    out = analytics.distribution(spark.read.parquet(str(tmp_path / "t")), "k")
    assert sorted((r.k, r.rows, r.share) for r in out.collect()) == [(k, 25, 0.25) for k in range(4)]
    final = out._jdf.queryExecution().executedPlan()
    out._jdf.collectToPython()
    text = final.toString()
    text = text.split("== Initial Plan ==")[0]
    assert "ReusedExchange" in text
