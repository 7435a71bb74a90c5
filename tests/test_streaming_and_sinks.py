"""Sinks with a client that keeps what it gets; streams, watermarks, routing, monitoring."""

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from driftloom.operators import analytics, sizing
from driftloom.sources.rows import microbatch_rows
from driftloom.sources.tables import envelope_stream, table
from driftloom.streaming.monitor import progress
from driftloom.streaming.record_sink import RecordBatchWriter, RecordSink, RecordStreamWriter, Sent, stream_client
from driftloom.streaming.writers import flat_only, route, write

SF = "/root/testdata/sf0.001"


class Client:
    """Fails the records whose data are in ``bad``, so many times."""

    def __init__(self, bad=(), times=10**9, broken=False):
        self.calls, self.bad, self.times, self.broken = [], set(bad), times, broken

    def put_records(self, StreamName, Records):  # noqa: N803
        self.calls.append(Records)
        if self.broken:
            raise OSError("no network")
        answers = []
        for r in Records:
            fail = r["Data"] in self.bad and self.times > 0
            self.times -= fail
            answers.append({"ErrorCode": "Throttled"} if fail else {"SequenceNumber": "1"})
        return {"FailedRecordCount": sum("ErrorCode" in a for a in answers), "Records": answers}


def run(rows, client, kind=RecordStreamWriter, **options):
    return kind({"stream_name": "s"} | options, lambda _: client).write(iter(rows))


def some(n):
    return [Row(partition_key=f"k{i}", data=f"d{i}") for i in range(n)]


def test_calls_of_500():
    client = Client()
    assert run(some(1203), client) == Sent(1203, 0, 0)
    assert sorted(map(len, client.calls)) == [203, 500, 500]
    assert {r["Data"] for c in client.calls for r in c} == {f"d{i}".encode() for i in range(1203)}


def test_nulls_are_skipped_and_bytes_kept():
    client = Client()
    rows = [Row(partition_key=None, data="a"), Row(partition_key="k", data=None), Row(partition_key=7, data=b"\x00\xff")]
    assert run(rows, client) == Sent(1, 0, 2)
    assert client.calls == [[{"Data": b"\x00\xff", "PartitionKey": "7"}]]
    assert run([], Client()) == Sent(0, 0, 0)


def test_failures_are_counted_and_commit():
    assert run(some(10), Client(bad=[b"d3", b"d4"])) == Sent(8, 2, 0)
    assert run(some(600), Client(broken=True)) == Sent(0, 600, 0)


def test_retries_send_the_failed_records_only():
    client = Client(bad=[b"d3", b"d4"], times=2)
    assert run(some(10), client, retries="2") == Sent(10, 0, 0)
    assert [len(c) for c in client.calls] == [10, 2]


def test_strict_writer_fails():
    with pytest.raises(RuntimeError, match="1 of 5"):
        run(some(5), Client(bad=[b"d1"]), RecordBatchWriter, fail_on_error="true")


def test_totals_and_options():
    assert RecordStreamWriter.total([Sent(1, 2, 3), None, Sent(4, 5, 6)]) == Sent(5, 7, 9)
    writer = RecordStreamWriter({"stream_name": "s"})
    writer.commit([Sent(1)], 0)
    writer.abort([None], 0)
    for bad in ({}, {"stream_name": "s", "aws_access_key_id": "a"}, {"stream_name": "s", "aws_secret_access_key": "a"}):
        with pytest.raises(ValueError):
            RecordStreamWriter(bad)
    with pytest.raises(ImportError):
        stream_client({"stream_name": "s"})


def file_client(options):
    """A client that appends to files; executors import it by name."""
    import json
    import uuid

    class ToFiles:
        def put_records(self, StreamName, Records):  # noqa: N803
            with open(f"{StreamName}/{uuid.uuid4().hex}", "w") as f:
                json.dump([[r["PartitionKey"], r["Data"].decode()] for r in Records], f)
            return {"FailedRecordCount": 0, "Records": [{}] * len(Records)}

    return ToFiles()


@pytest.fixture
def test_module_on_workers(spark):
    import os
    from pathlib import Path

    env = spark.sparkContext.environment
    before = env.get("PYTHONPATH", "")
    env["PYTHONPATH"] = os.pathsep.join([str(Path(__file__).parent), str(Path(__file__).parents[1]), before])
    yield Path(__file__).stem
    env["PYTHONPATH"] = before


def test_data_source_batch_and_stream(spark, tmp_path, test_module_on_workers):
    import json

    spark.dataSource.register(RecordSink)
    df = spark.range(1200).select(F.col("id").cast("string").alias("partition_key"), F.concat(F.lit("d"), "id").alias("data"))
    factory = f"{test_module_on_workers}:file_client"
    for kind in ("batch", "stream"):
        out = tmp_path / kind
        out.mkdir()
        if kind == "batch":
            write(df, "driftloom_records", stream_name=str(out), client_factory=factory)
        else:
            df.write.parquet(str(tmp_path / "in"))
            stream = envelope_stream(spark, str(tmp_path / "in"))
            write(stream, "driftloom_records", checkpoint=str(tmp_path / "cp"), trigger={"availableNow": True}, stream_name=str(out), client_factory=factory).awaitTermination()
        got = [tuple(r) for f in out.iterdir() for r in json.loads(f.read_text())]
        assert sorted(got) == sorted((str(i), f"d{i}") for i in range(1200))


def test_file_sinks(spark, tmp_path):
    df = spark.range(100).selectExpr("id", "id % 3 AS k")
    write(df, "parquet", str(tmp_path / "p"), partition_by=("k",), maxRecordsPerFile=10)
    assert spark.read.parquet(str(tmp_path / "p")).count() == 100 and len(list((tmp_path / "p").glob("k=*"))) == 3
    with pytest.raises(ValueError, match="nested"):
        flat_only(spark.createDataFrame([(1, [1])], "a int, b array<int>"))
    with pytest.raises(ValueError, match="unknown sink"):
        write(df, "tape")


@pytest.mark.parametrize("fmt", ["delta", "kafka"])
def test_sinks_without_their_package(spark, fmt, tmp_path):
    df = spark.createDataFrame([("a", "b")], "partition_key string, data string")
    with pytest.raises(RuntimeError, match="package"):
        write(df, fmt, str(tmp_path / "d"))


def test_restart_goes_on_where_it_stopped(spark, tmp_path):
    for k in range(2):
        spark.range(k * 50, k * 50 + 50).selectExpr("cast(id as string) partition_key", "cast(id as string) data").write.mode("append").parquet(str(tmp_path / "in"))
        stream = envelope_stream(spark, str(tmp_path / "in"))
        write(stream, "json", str(tmp_path / "out"), checkpoint=str(tmp_path / "cp"), trigger={"availableNow": True}).awaitTermination()
    got = [r.data for r in spark.read.json(str(tmp_path / "out")).collect()]
    assert sorted(map(int, got)) == list(range(100))


def test_watermark_closes_windows(spark, tmp_path):
    events = table(spark, SF, "events", "ts", "event_type", "value")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    windows = analytics.windowed(stream, "ts", ("event_type",), ("value",), "10 minutes")
    query = write(windows, "memory", query_name="closed", trigger={"availableNow": True})
    query.awaitTermination()
    whole = analytics.windowed(events, "ts", ("event_type",), ("value",), "10 minutes", watermark=None)
    got = {(r.window_start, r.event_type): r.event_count for r in spark.table("closed").collect()}
    want = {(r.window_start, r.event_type): r.event_count for r in whole.collect()}
    assert got.items() <= want.items() and len(want) - len(got) <= 5
    rows = progress(query).collect()
    assert sum(r.input_rows for r in rows) == events.count()


def test_sliding_windows(spark):
    events = table(spark, SF, "events", "ts", "value")
    slid = analytics.windowed(events, "ts", (), (), "10 minutes", "5 minutes", watermark=None)
    assert slid.agg(F.sum("event_count")).first()[0] == 2 * events.count()


def test_routing(spark, tmp_path):
    spark.range(30).selectExpr("id", "elt(1 + id % 3, 'a', 'b', 'c') AS kind").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, kind string").parquet(str(tmp_path / "in"))
    sink = lambda df, name: df.write.mode("append").parquet(str(tmp_path / name))
    route(stream, "kind", {"one": ("a", "c"), "two": ("b",)}, sink, checkpointLocation=str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "one")).count() == 20 and spark.read.parquet(str(tmp_path / "two")).count() == 10


def test_microbatch_source(spark):
    query = microbatch_rows(spark, 5).writeStream.format("memory").queryName("micro").trigger(processingTime="100 milliseconds").start()
    query.processAllAvailable() if False else query.awaitTermination(8)
    query.stop()
    ids = sorted(r.id for r in spark.table("micro").collect())
    assert len(ids) >= 5 and ids == list(range(len(ids)))


def test_sizing(spark):
    assert [sizing.shards(x) for x in (0, 1, 1000, 1001, 5000.5)] == [1, 1, 1, 2, 6]
    for kind in ("baseline", "peak", "burst", "soak", "degradation"):
        rates = [r.rate for r in sizing.load_profile(spark, kind, 100, 10, 20).collect()]
        assert len(rates) == 100 and min(rates) >= 10
    with pytest.raises(ValueError):
        sizing.load_profile(spark, "storm", 1, 1, 1)
    rows = sizing.backlog(sizing.load_profile(spark, "burst", 100, 10, 30), 15).orderBy("second").collect()
    left = 0.0
    for r in rows:
        left = max(0.0, left + r.rate - 15)
        assert abs(r.backlog - left) < 1e-9
    steps = spark.createDataFrame([(1, 10.0, 12.0), (2, 20.0, 18.0)], "step int, input_rate double, processing_rate double")
    assert [r.marginal for r in sizing.headroom_steps(steps).orderBy("step").collect()] == [None, 0.6]


def test_percentiles_approximate(spark):
    events = table(spark, SF, "events", "event_type", "value")
    near = {r.event_type: r.p50 for r in analytics.percentiles(events, "value", ("event_type",)).collect()}
    exact = {r.event_type: r.p50 for r in analytics.percentiles(events, "value", ("event_type",), exact=True).collect()}
    assert all(abs(near[k] - exact[k]) < 5 for k in exact)


def test_an_answer_that_hides_its_failures_is_not_sent_again():
    class Silent:
        calls = 0

        def put_records(self, StreamName, Records):  # noqa: N803
            self.calls += 1
            return {"FailedRecordCount": 2, "Records": [{} for _ in Records]}

    client = Silent()
    assert run(some(10), client, retries="3", retry_seconds="0") == Sent(8, 2, 0) and client.calls == 1


def test_service_credential_gives_the_client(monkeypatch):
    import sys
    from types import ModuleType, SimpleNamespace

    asked = []
    module = ModuleType("own_credentials")
    module.session = lambda name: SimpleNamespace(client=lambda kind, region_name: asked.append((name, kind, region_name)) or "client")
    monkeypatch.setitem(sys.modules, "own_credentials", module)
    monkeypatch.setitem(sys.modules, "boto3", ModuleType("boto3"))
    options = {"service_credential": "cred", "credential_provider": "own_credentials:session", "region": "eu-west-1"}
    assert stream_client(options) == "client" and asked == [("cred", "kinesis", "eu-west-1")]
    with pytest.raises(ValueError, match="credential_provider"):
        stream_client({"service_credential": "cred"})


def test_replays_begin_where_they_are_told(spark, tmp_path):
    path = str(tmp_path / "envelopes")
    rows = lambda k: spark.createDataFrame([(f"k{k}", f"d{k}")], "partition_key string, data string")
    rows(1).coalesce(1).write.mode("append").parquet(path)
    rows(2).coalesce(1).write.mode("append").parquet(path)

    def replay(name, **options):
        out = str(tmp_path / name)
        query = write(envelope_stream(spark, path, **options), "parquet", out, checkpoint=f"{out}-log", trigger={"availableNow": True})
        query.awaitTermination()
        return sorted(r.data for r in spark.read.parquet(out).collect()), len(query.recentProgress)

    assert replay("all")[0] == ["d1", "d2"]
    assert replay("none", start="latest")[0] == []
    assert replay("since", start="2000-01-01 00:00:00")[0] == ["d1", "d2"]
    found, batches = replay("small", files_per_batch=1)
    assert found == ["d1", "d2"] and batches >= 2


def test_a_stream_into_a_table(spark, tmp_path):
    name = "driftloom_stream_table"
    stream = envelope_stream(spark, _files(spark, tmp_path), start="earliest")
    path = str(tmp_path / "table")
    write(stream, "parquet", path, checkpoint=f"{path}-log", trigger={"availableNow": True}, table=name).awaitTermination()
    assert spark.table(name).count() == 3
    spark.sql(f"DROP TABLE {name}")


def _files(spark, tmp_path):
    path = str(tmp_path / "source")
    spark.createDataFrame([("k", f"d{k}") for k in range(3)], "partition_key string, data string").write.parquet(path)
    return path


def test_avro_payloads_need_their_package(spark):
    from driftloom import ConfigurationError
    from driftloom.operators.envelope import avro_envelope

    try:
        rows = avro_envelope(spark.createDataFrame([("a", 1)], "k string, n int"), "k").collect()
    except ConfigurationError as error:
        assert "Avro package" in str(error)
    else:
        assert isinstance(rows[0].data, bytes | bytearray)
