"""The generator's invariants: types, shares, reproducibility, batches and streams."""

from collections import Counter
from math import sqrt

import pytest
from pyspark.sql import functions as F

from driftloom import ConfigurationError, Generator, StreamOrchestrator, load_config_from_dict
from driftloom.functions.text import PROVIDERS
from driftloom.operators.generate import type_of


def config(common=None, events=None, derived=None, **more):
    return load_config_from_dict(
        {
            "generation_mode": "batch",
            "batch_config": {"total_rows": 20_000, "partitions": 4},
            "sink_config": {"type": "x"},
            "event_types": events or [{"event_type_id": "only", "weight": 1}],
            "common_fields": common or {},
            "derived_fields": derived or {},
        }
        | more
    )


def rows(spark, *args, n=None, **kwargs):
    return Generator(spark, config(*args, **kwargs).spec()).batch(n)


SCALARS = {
    "uuid": "string", "string": "string", "int": "int", "long": "bigint", "short": "smallint", "byte": "tinyint",
    "float": "float", "double": "double", "decimal": "decimal(10,2)", "boolean": "boolean", "timestamp": "timestamp",
    "date": "date", "binary": "binary",
}


@pytest.mark.parametrize("draws", ["fast", "portable"])
def test_types_and_columns(spark, draws):
    common = {f"c_{k}": {"type": k} for k in SCALARS}
    common["arr"] = {"type": "array", "item_type": "decimal", "precision": 6, "scale": 1, "range": [0, 9]}
    common["st"] = {"type": "struct", "fields": {"a": {"type": "int"}, "m": {"type": "map", "values": [{"k": "v"}]}}}
    common["mp"] = {"type": "map", "value_type": "long", "values": [{"k": 1}]}
    df = rows(spark, common, derived={"d": {"type": "long", "expr": "c_int + 1"}}, draws=draws, n=50)
    kinds = dict(df.dtypes)
    assert df.columns == [*common, "d"]
    assert all(kinds[f"c_{k}"] == v for k, v in SCALARS.items())
    assert kinds["arr"] == "array<decimal(6,1)>" and kinds["st"] == "struct<a:int,m:map<string,string>>"
    assert kinds["mp"] == "map<string,bigint>" and kinds["d"] == "bigint"
    got = df.collect()
    assert len(got) == 50 and all(r.c_uuid and r.c_date and 1 <= len(r.arr) <= 5 and len(r.c_binary) == 16 for r in got)
    assert len({r.c_uuid for r in got}) == 50
    if draws == "fast":
        assert all(r.c_uuid[14] == "4" and r.c_uuid[19] in "89ab" for r in got)


def test_same_for_any_partitioning_and_seed(spark):
    common = {"a": {"type": "long"}, "b": {"type": "string", "values": ["x", "y"], "percent_nulls": 0.5}}
    one = config(common, batch_config={"total_rows": 500, "partitions": 1})
    many = config(common, batch_config={"total_rows": 500, "partitions": 7})
    other = config(common, batch_config={"total_rows": 500}, seed=43)
    sets = [sorted(map(str, Generator(spark, c.spec()).batch().collect())) for c in (one, one, many, other)]
    assert sets[0] == sets[1] == sets[2] != sets[3]


def _share(count, n, p):
    assert abs(count / n - p) < 5 * sqrt(p * (1 - p) / n), (count, n, p)


@pytest.mark.parametrize("draws", ["fast", "portable"])
def test_shares(spark, draws):
    common = {
        "k": {"event_type_id": True},
        "w": {"type": "string", "values": ["a", "b", "c"], "weights": [5, 3, 2]},
        "o": {"type": "int", "range": [0, 10], "outliers": [{"percent": 0.1, "expr": "-1"}, {"percent": 0.05, "expr": "-2"}, {"percent": 0.02, "expr": "-3"}, {"percent": 0.03, "expr": "-4"}], "percent_nulls": 0.2},
        "b": {"type": "boolean"},
    }
    events = [{"event_type_id": f"e{k}", "weight": k + 1} for k in range(6)]
    got = rows(spark, common, events, draws=draws).collect()
    n = len(got)
    for k in range(6):
        _share(sum(r.k == f"e{k}" for r in got), n, (k + 1) / 21)
    for v, p in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
        _share(sum(r.w == v for r in got), n, p)
    _share(sum(r.o is None for r in got), n, 0.2)
    for v, p in ((-1, 0.1), (-2, 0.05), (-3, 0.02), (-4, 0.03)):
        _share(sum(r.o == v for r in got), n, 0.8 * p)
    _share(sum(r.b for r in got), n, 0.5)
    # draws of different fields don't depend on each other
    _share(sum(r.w == "a" and r.b for r in got), n, 0.25)


def test_conditional_fields_are_null_elsewhere(spark):
    events = [
        {"event_type_id": "a.b", "weight": 1, "fields": {"x": {"type": "int", "range": [1, 9]}, "s": {"type": "struct", "fields": {"v": {"type": "int", "range": [0, 2]}}}}},
        {"event_type_id": "a_b", "weight": 1, "fields": {"y": {"type": "string", "values": ["it's", 'say "so"']}, "s": {"type": "struct", "fields": {"v": {"type": "int", "range": [50, 60]}}}}},
    ]
    for r in rows(spark, {"k": {"event_type_id": True}}, events, n=2000).collect():
        assert (r.x is None) == (r.k != "a.b") and (r.y is None) == (r.k != "a_b")
        assert (r.s.v < 2) == (r.k == "a.b") and r.y in (None, "it's", 'say "so"')


def test_bounds(spark):
    common = {
        "i": {"type": "int", "range": [-5, 5]},
        "full": {"type": "long", "range": [-(2**63), 2**63 - 1]},
        "six": {"type": "int", "range": [1, 6], "inclusive": True},
        "d": {"type": "date", "range": ["2024-02-28", "2024-03-02"]},
        "t": {"type": "timestamp", "begin": "2024-01-01", "end": "2024-01-02"},
        "arr": {"type": "array", "item_type": "int", "num_features": [0, 3], "range": [0, 4]},
    }
    got = rows(spark, common, n=5000).collect()
    assert {r.i for r in got} == set(range(-4, 5)) and {r.six for r in got} == set(range(1, 7))
    assert {str(r.d) for r in got} == {"2024-02-28", "2024-02-29", "2024-03-01"}
    assert {len(r.arr) for r in got} == {0, 1, 2, 3}
    assert min(r.full for r in got) < -(2**61) and max(r.full for r in got) > 2**61


def test_array_length_per_type(spark):
    events = [{"event_type_id": f"e{k}", "weight": 1} for k in range(5)]
    common = {"k": {"event_type_id": True}, "arr": {"type": "array", "item_type": "int", "num_features": [1, 5], "length_per_type": True}}
    seen = {}
    for r in rows(spark, common, events, n=500).collect():
        seen.setdefault(r.k, set()).add(len(r.arr))
    assert all(len(x) == 1 for x in seen.values())


def test_derived_fields(spark):
    derived = {"a": {"type": "int", "expr": "n + 1"}, "b": {"type": "int", "expr": "a * 2"}, "c": {"type": "string", "expr": "concat(b, '!')", "percent_nulls": 0.5}}
    got = rows(spark, {"n": {"type": "int"}}, derived=derived, n=200).collect()
    assert all(r.b == 2 * (r.n + 1) and r.c in (None, f"{r.b}!") for r in got) and {r.c is None for r in got} == {True, False}
    with pytest.raises(ConfigurationError, match="derived_fields.a"):
        rows(spark, derived={"a": {"type": "int", "expr": "missing + 1"}})


@pytest.mark.parametrize("method", sorted(PROVIDERS))
def test_text_providers(spark, method):
    args = {"sentence": {"nb_words": 4}, "paragraph": {"nb_sentences": 2}, "text": {"max_nb_chars": 60}}.get(method, {})
    got = [r.v for r in rows(spark, {"v": {"type": "string", "faker": method, "faker_args": args}}, n=300).collect()]
    assert all(got) and len(set(got)) > 10
    if method == "sentence":
        assert all(len(x.split()) == 4 and x[0].isupper() and x.endswith(".") for x in got)
    if method == "text":
        assert max(map(len, got)) <= 60 < 2 * min(map(len, got))
    if method == "credit_card_number":
        for x in got:
            d = [int(c) for c in reversed(x)]
            assert len(d) == 16 and sum(v if k % 2 == 0 else v * 2 - 9 * (v > 4) for k, v in enumerate(d)) % 10 == 0


def test_unknown_text_provider(spark):
    with pytest.raises((ImportError, AttributeError)):
        rows(spark, {"v": {"type": "string", "faker": "no_such_method"}})


def test_many_event_types(spark):
    events = [{"event_type_id": f"t{k}", "weight": 1 + k % 3, "fields": {f"f{k % 20}": {"type": "int", "range": [k % 20, 100]}}} for k in range(1500)]
    c = config({"k": {"event_type_id": True}}, events)
    got = Generator(spark, c.spec()).batch(3000).collect()
    assert len(got[0]) == 21 and len({r.k for r in got}) > 1000
    assert all((r[f"f{int(r.k[1:]) % 20}"] is not None) and sum(x is not None for x in r) == 2 for r in got)
    spec = c.spec()
    counts = Counter(type_of(spec, (k + 0.5) / 30_000) for k in range(30_000))
    assert abs(counts["t2"] / counts["t0"] - 3) < 0.5


def test_filters_and_columns_are_pushed_through(spark):
    df = rows(spark, {"k": {"event_type_id": True}, "a": {"type": "long"}, "t": {"type": "string", "faker": "paragraph"}}, [{"event_type_id": x, "weight": 1} for x in "pq"])
    plan = df.filter("k = 'p'").select("a")._jdf.queryExecution().optimizedPlan().toString()
    assert "amber" not in plan and plan.index("Filter") > plan.index("Project")


def test_stream_equals_batch(spark, tmp_path):
    c = config({"k": {"event_type_id": True}, "v": {"type": "long"}, "arr": {"type": "array", "item_type": "int"}}, [{"event_type_id": x, "weight": 1} for x in "pq"])
    ids = spark.range(0, 300, 1, 3)
    ids.write.parquet(str(tmp_path / "ids"))
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "ids"))
    made = Generator(spark, c.spec()).apply(stream, "id", ("id",))
    made.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    want = Generator(spark, c.spec()).apply(spark.range(300), "id", ("id",))
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(str, want.collect()))


def test_rate_stream_and_orchestrator(spark):
    data = {
        "generation_mode": "streaming",
        "streaming_config": {"total_rows_per_second": 100},
        "sink_config": {"type": "kinesis", "partition_key_field": "name"},
        "event_types": [{"event_type_id": "a", "weight": 3, "fields": {"x": {"type": "int"}}}, {"event_type_id": "b", "weight": 1}],
        "common_fields": {"name": {"event_type_id": True}},
    }
    made = StreamOrchestrator(spark, load_config_from_dict(data))
    assert made.calculate_rates() == {"a": 75.0, "b": 25.0}
    stream = made.create_unified_stream()
    assert stream.isStreaming and stream.columns == ["partition_key", "data"]
    assert made.create_unified_stream(serialize=False).columns == ["name", "x"]
    batch = StreamOrchestrator(spark, load_config_from_dict(data | {"generation_mode": "batch", "batch_config": {"total_rows": 20}}))
    assert batch.calculate_rates() == {}
    got = batch.create_unified_stream().collect()
    assert len(got) == 20 and all(f'"name":"{r.partition_key}"' in r.data and "event_timestamp" in r.data for r in got)
    with pytest.raises(ValueError, match="partition_key_field"):
        StreamOrchestrator(spark, load_config_from_dict(data | {"sink_config": {"type": "x"}})).create_unified_stream()


def test_envelope_round_trip_of_all_types(spark):
    from driftloom.operators.envelope import envelope, from_envelope

    common = {k: {"type": k} for k in SCALARS if k not in ("float", "timestamp")}
    common["arr"] = {"type": "array", "item_type": "int"}
    common["st"] = {"type": "struct", "fields": {"a": {"type": "int", "percent_nulls": 0.5}}}
    common["mp"] = {"type": "map", "values": [{"k": "v"}, {}]}
    wide = rows(spark, common, n=100)
    back = from_envelope(envelope(wide, "uuid"), wide.schema)
    assert sorted(map(str, back.collect())) == sorted(map(str, wide.collect()))
    assert wide.select(F.col("uuid")).distinct().count() == 100
