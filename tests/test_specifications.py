"""Specifications: parsing, and one test per rule."""

import copy

import pytest

from driftloom import Config, ConfigurationError, load_config, load_config_from_dict

GOOD = {
    "generation_mode": "batch",
    "batch_config": {"total_rows": 10},
    "sink_config": {"type": "kinesis", "partition_key_field": "key"},
    "common_fields": {
        "event_name": {"event_type_id": True},
        "key": {"type": "string", "values": ["a", "b"], "weights": [1, 2]},
        "loc": {"type": "struct", "fields": {"lat": {"type": "double", "range": [0.0, 1.0]}, "who": {"type": "string", "faker": "name"}}},
    },
    "event_types": [
        {"event_type_id": "x", "weight": 2, "fields": {"n": {"type": "int", "range": [0, 5]}, "l": {"type": "array", "item_type": "int"}}},
        {"event_type_id": "y", "weight": 1, "fields": {"n": {"type": "int"}, "m": {"type": "map", "values": [{"a": "b"}]}}},
    ],
    "derived_fields": {"twice": {"type": "int", "expr": "n * 2"}},
}


def changed(path, value):
    d = copy.deepcopy(GOOD)
    at = d
    for p in path[:-1]:
        at = at[p]
    if value is KeyError:
        del at[path[-1]]
    else:
        at[path[-1]] = value
    return d


BAD = [
    (["event_types"], KeyError),
    (["generation_mode"], KeyError),
    (["sink_config"], KeyError),
    (["event_types"], []),
    *((["event_types", 0, "weight"], w) for w in (0, -1, 0.6, "2", None, True, KeyError)),
    (["event_types", 1, "event_type_id"], "x"),
    (["common_fields", "key", "weights"], [0.2, 0.8]),
    (["common_fields", "key", "weights"], [1]),
    (["common_fields", "key", "weights"], [1, 0]),
    (["generation_mode"], "micro"),
    (["generation_mode"], "streaming"),
    (["batch_config"], KeyError),
    (["batch_config", "total_rows"], "many"),
    (["sink_config"], {}),
    (["sink_config", "partition_key_field"], "absent"),
    (["derived_fields", "twice"], {"type": "int"}),
    (["derived_fields", "twice"], {"expr": "1"}),
    (["derived_fields", "twice"], {"type": "number", "expr": "1"}),
    (["derived_fields", "twice", "values"], [1]),
    (["derived_fields", "n"], {"type": "int", "expr": "1"}),
    (["common_fields", "key", "type"], "text"),
    (["common_fields", "loc", "fields", "lat", "type"], "real"),
    (["event_types", 0, "fields", "l", "item_type"], "thing"),
    (["common_fields", "key", "outliers"], {"percent": 0.1}),
    (["common_fields", "key", "outliers"], [{"expr": "1"}]),
    (["common_fields", "key", "outliers"], [{"percent": 0.1}]),
    (["common_fields", "key", "outliers"], [{"percent": 0, "expr": "1"}]),
    (["common_fields", "key", "outliers"], [{"percent": 1.0, "expr": "1"}]),
    (["common_fields", "key", "outliers"], [{"percent": 0.6, "expr": "1"}, {"percent": 0.6, "expr": "2"}]),
    (["common_fields", "loc", "fields", "lat", "outliers"], [{"percent": 2, "expr": "1"}]),
    (["common_fields", "key", "percent_nulls"], -0.1),
    (["common_fields", "key", "percent_nulls"], 1.0),
    (["common_fields", "loc", "fields", "lat", "percent_nulls"], 7),
    (["event_types", 1, "fields", "n"], {"type": "long"}),
    (["event_types", 1, "fields", "key"], {"type": "int"}),
    (["event_types", 1, "fields", "event_name"], {"type": "int"}),
    (["event_types", 1, "fields", "l"], {"type": "array", "item_type": "string"}),
    (["event_types", 1, "fields", "loc"], {"type": "struct", "fields": {"lat": {"type": "float"}, "who": {"type": "string"}}}),
    (["event_types", 1, "fields", "loc"], {"type": "struct", "fields": {"lat": {"type": "double"}}}),
    (["event_types", 0, "fields", "m"], {"type": "map", "value_type": "int"}),
    (["event_types", 0, "fields", "n", "faker"], "name"),
    (["common_fields", "key", "faker"], "name"),
    (["common_fields", "k2"], {"type": "string", "faker": ""}),
    (["common_fields", "k2"], {"type": "string", "faker": "name", "faker_args": [1]}),
    (["common_fields", "k2"], {"type": "string", "faker": "name", "expr": "1"}),
    (["common_fields", "loc", "fields", "who", "values"], ["a"]),
    (["common_fields", "__row_id"], {"type": "int"}),
    (["event_types", 0, "fields", "__draw"], {"type": "int"}),
    (["derived_fields", "__x"], {"type": "int", "expr": "1"}),
    (["common_fields", "event_name", "values"], ["a"]),
    (["common_fields", "event_name", "event_type_id"], False),
    (["event_types", 0, "fields", "n"], {"event_type_id": True}),
    (["derived_fields", "d"], {"event_type_id": True}),
    (["common_fields", "s"], {"type": "short", "range": [1024, 65535]}),
    (["common_fields", "s"], {"type": "int", "range": [5, 1]}),
    (["common_fields", "s"], {"type": "decimal", "precision": 4, "scale": 2}),
    (["common_fields", "s"], {"type": "uuid", "values": ["a"]}),
    (["common_fields", "s"], {"type": "string", "range": [1, 2]}),
    (["common_fields", "s"], {"type": "array", "num_features": [3, 1]}),
    (["common_fields", "s"], {"type": "struct"}),
    (["common_fields", "s"], {"type": "map", "values": [{"a": 1}], "weights": [1, 2]}),
    (["draws"], "quick"),
    (["seed"], "x"),
    (["serialization_format"], "protobuf"),
    (["serialization_format"], "binary"),
]


def test_the_good_one():
    c = load_config_from_dict(GOOD)
    spec = c.spec()
    assert [e.id for e in spec.event_types] == ["x", "y"]
    assert list(spec.conditional) == ["n", "l", "m"] and list(spec.conditional["n"]) == ["x", "y"]
    assert spec.partitions == 8 and spec.partition_key == "key"


@pytest.mark.parametrize("k", range(len(BAD)))
def test_each_rule(k):
    with pytest.raises(ConfigurationError):
        load_config_from_dict(changed(*BAD[k]))


def test_reads_like_a_mapping():
    c = Config(GOOD)
    assert c.get("sink_config.type") == "kinesis" and c.get("batch_config.none", 5) == 5 and c.get("a.b") is None
    assert c.get("generation_mode.x", 1) == 1
    assert c["generation_mode"] == "batch" and "draws" not in c
    with pytest.raises(KeyError):
        c["none"]


def test_files(tmp_path):
    import yaml

    with pytest.raises(FileNotFoundError):
        load_config(str(tmp_path / "none.yaml"))
    for text in ("", "a: [", "- 1"):
        (tmp_path / "bad.yaml").write_text(text)
        with pytest.raises(ConfigurationError):
            load_config(str(tmp_path / "bad.yaml"))
    (tmp_path / "good.yaml").write_text(yaml.safe_dump(GOOD, sort_keys=False))
    assert load_config(str(tmp_path / "good.yaml")).spec() == Config(GOOD).spec()
