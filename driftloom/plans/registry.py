"""One query per operator over the test tables, each with the same in DuckDB SQL.

Generators run over existing tables by their ids, with portable draws: ``u`` below is
the SQL of such a draw.
"""

from __future__ import annotations

import copy
import json
import time
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.operators import analytics, envelope, sizing
from driftloom.operators.generate import TYPE_PATH, Generator
from driftloom.plans import documents, relational  # noqa: F401  registers its queries
from driftloom.plans.catalog import ORACLES, QUERIES, Query, query
from driftloom.plans.spec import Config, load_config, load_config_from_dict
from driftloom.sources.rows import batch_rows, stream_rows
from driftloom.sources.shared import shared_path
from driftloom.sources.tables import envelope_stream, table_stream
from driftloom.streaming import record_files
from driftloom.streaming.monitor import ProgressLog
from driftloom.streaming.record_sink import RecordSink
from driftloom.streaming.writers import for_kafka, read_merged, write

def u(path: str, role: str = "value", row_id: str = "event_id", seed: int = 42) -> str:
    return f"(('0x'||substr(md5('{seed}|{path}|{role}|'||{row_id}),1,12))::BIGINT/281474976710656::DOUBLE)"


def hexes(path: str, row_id: str = "event_id", seed: int = 42) -> str:
    return f"md5('{seed}|{path}|value|'||{row_id})"


def config(common: dict | None = None, events: list | None = None, derived: dict | None = None, **more: Any) -> Config:
    return load_config_from_dict(
        {
            "generation_mode": "batch",
            "batch_config": {"total_rows": 1000, "partitions": 4},
            "sink_config": {"type": "parquet"},
            "seed": 42,
            "draws": "portable",
            "event_types": events or [{"event_type_id": "only", "weight": 1}],
            "common_fields": common or {},
            "derived_fields": derived or {},
        }
        | more
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def over_events(spark: SparkSession, sf_dir: str, c: Config) -> DataFrame:
    return Generator(spark, c.spec()).apply(events(spark, sf_dir).select("event_id"), "event_id", ("event_id",))


def seconds(column: str) -> Column:
    """Seconds since 1970 of a time without zone."""
    return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {column})")


def field(name: str, spec: dict, sql: str, shown: Callable[[], Column] | None = None) -> None:
    """A query of one common field ``v``; ``sql`` is its value, ``shown`` what is returned of it."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = over_events(spark, sf_dir, config({"v": spec}))
        return out.select("event_id", (shown() if shown else F.col("v")).alias("v"))

    query(name, f"SELECT event_id, {sql} AS v FROM events")(run)


# --- event types --------------------------------------------------------------------------

_TWO = [
    {"event_type_id": "page", "weight": 6, "fields": {}},
    {"event_type_id": "buy", "weight": 4, "fields": {"qty": {"type": "int", "range": [1, 100]}}},
]
_DEVICE = {"type": "string", "values": ["ios", "android", "web"], "weights": [5, 3, 2]}
_TYPE_SQL = f"CASE WHEN {u(TYPE_PATH)} < 6/10.0::DOUBLE THEN 'page' ELSE 'buy' END"
_DEVICE_SQL = f"CASE WHEN {u('device')} < 5/10.0::DOUBLE THEN 'ios' WHEN {u('device')} < 8/10.0::DOUBLE THEN 'android' ELSE 'web' END"
_QTY_SQL = f"CASE WHEN {_TYPE_SQL} = 'buy' THEN CAST(trunc({u('qty@buy')}*(100-1)+1) AS INT) END"


@query(
    "e1_weighted_type",
    f"""WITH f AS (SELECT {_TYPE_SQL} AS event_name, {_DEVICE_SQL} AS device, {_QTY_SQL} AS qty FROM events)
    SELECT event_name, device, count(*) AS n, sum(qty)::BIGINT AS sum_qty, round(avg(qty), 6) AS avg_qty FROM f GROUP BY 1, 2""",
)
def e1_weighted_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = config({"event_name": {"event_type_id": True}, "device": _DEVICE}, _TWO)
    wide = over_events(spark, sf_dir, c)
    return wide.groupBy("event_name", "device").agg(
        F.count("*").alias("n"), F.sum("qty").alias("sum_qty"), F.round(F.avg("qty"), 6).alias("avg_qty")
    )


@query("e2_discriminator_alias", f"SELECT event_id, {_TYPE_SQL} AS kind FROM events")
def e2_discriminator_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return over_events(spark, sf_dir, config({"kind": {"event_type_id": True}}, _TWO)).select("event_id", "kind")


def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types with as many as a weight as there are rows of them."""
    return events(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("weight"))


@query("e3_rates", "SELECT event_type, 1000.0 * count(*) / sum(count(*)) OVER () AS rows_per_second FROM events GROUP BY 1")
def e3_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A thousand rows per second, shared as the types of the table are."""
    return sizing.spread(_measured(spark, sf_dir), "weight", 1000.0, "rows_per_second").drop("weight")


@query(
    "e4_expected_rows",
    "SELECT event_type, (SELECT count(*) FROM orders)::DOUBLE * count(*) / sum(count(*)) OVER () AS rows FROM events GROUP BY 1",
)
def e4_expected_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of as many rows as there are orders, shared likewise."""
    total = spark.read.parquet(f"{sf_dir}/orders.parquet").agg(F.count("*").cast("double")).scalar()
    return sizing.spread(_measured(spark, sf_dir), "weight", total, "rows").drop("weight")


@query(
    "e5_shards",
    "SELECT event_type, greatest(1, ceil(count(*)*2.5/1000))::INT AS shards FROM events GROUP BY 1",
)
def e5_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = F.count("*") * 2.5
    return events(spark, sf_dir).groupBy("event_type").agg(sizing.shards_column(rate).alias("shards"))


_MANY = [{"event_type_id": f"t{k:04d}", "weight": 1 + k % 5, "fields": {f"f{k % 40}": {"type": "int", "range": [0, 10 + k % 40]}}} for k in range(300)]
_MANY_TOTAL = sum(e["weight"] for e in _MANY)


@query(
    "e6_many_types",
    f"""WITH b AS (SELECT k, 1 + k % 5 AS w, sum(1 + k % 5) OVER (ORDER BY k) AS upto FROM range(300) r(k)),
    d AS (SELECT floor({u(TYPE_PATH)}*{_MANY_TOTAL}) AS at FROM events)
    SELECT 't' || lpad(k::VARCHAR, 4, '0') AS event_name, count(*) AS n FROM d JOIN b ON d.at >= upto - w AND d.at < upto GROUP BY 1""",
)
def e6_many_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = over_events(spark, sf_dir, config({"event_name": {"event_type_id": True}}, _MANY))
    return wide.groupBy("event_name").agg(F.count("*").alias("n"))


# --- specifications and sources -----------------------------------------------------------


@query("s1_yaml_document", ORACLES["e1_weighted_type"])
def s1_yaml_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same table from a YAML document, which the driver alone reads."""
    import tempfile

    import yaml

    data = config({"event_name": {"event_type_id": True}, "device": _DEVICE}, _TWO).data
    with tempfile.NamedTemporaryFile("w", suffix=".yaml") as file:
        yaml.safe_dump(data, file, sort_keys=False)
        file.flush()
        wide = over_events(spark, sf_dir, load_config(file.name))
    return wide.groupBy("event_name", "device").agg(
        F.count("*").alias("n"), F.sum("qty").alias("sum_qty"), F.round(F.avg("qty"), 6).alias("avg_qty")
    )


@query("s5_row_ids", "SELECT count(*) AS rows, count(*) AS ids, count(*) AS same FROM events")
def s5_row_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many rows as the table has: each has an id of its own, whatever the partitions, and the table's ids give the same."""
    n = events(spark, sf_dir).count()
    made = lambda parts: Generator(spark, config({"v": {"type": "uuid"}}, batch_config={"total_rows": n, "partitions": parts}).spec()).batch()
    onto = over_events(spark, sf_dir, config({"v": {"type": "uuid"}}))
    same = made(3).join(onto, "v", "left_semi").agg(F.count("*")).scalar()
    counts = made(7).agg(F.count("*").alias("rows"), F.count_distinct("v").alias("ids"))
    return counts.select("rows", "ids", same.alias("same"))


@query("s3_batch_rows", "SELECT event_id, event_type FROM events")
def s3_batch_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of a batch as large as the table, with the rows that have them."""
    e = events(spark, sf_dir).select("event_id", "event_type")
    ids = batch_rows(spark, e.count(), 8).select(F.col("id").alias("event_id"))
    return ids.join(e, "event_id", "left")


@query("s7_table_scan", "SELECT event_id, user_id FROM events WHERE event_type = 'click' AND value > 50")
def s7_table_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).filter("event_type = 'click' AND value > 50").select("event_id", "user_id")


_WINDOW_SQL = """SELECT strftime(time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M:%S') AS window_start, event_type,
    count(*) AS event_count, round(avg(value), 6) AS avg_value, min(value) AS min_value, max(value) AS max_value,
    round(stddev_samp(value), 6) AS stddev_value FROM events GROUP BY 1, 2"""


def _shown_windows(windows: DataFrame) -> DataFrame:
    start = F.date_format(F.col("window_start").cast("timestamp_ntz"), "yyyy-MM-dd HH:mm:ss")
    return windows.select(
        start.alias("window_start"),
        "event_type",
        "event_count",
        F.round("avg_value", 6).alias("avg_value"),
        "min_value",
        "max_value",
        F.round("stddev_value", 6).alias("stddev_value"),
    )


@query("s4_rate_rows", "SELECT event_id, event_type FROM events")
def s4_rate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of an endless stream, joined with the table as they come, until all its rows have come; each once."""
    path, e = shared_path(spark, "rate"), events(spark, sf_dir).select("event_id", "event_type")
    first = e.count()
    ids = stream_rows(spark, max(5000, first // 2), 2).select(F.col("id").alias("event_id"))
    stream = write(ids.join(e, "event_id"), "parquet", path, checkpoint=shared_path(spark, "rate-log"))
    until, seen = time.monotonic() + 300, {}
    while sum(seen.values()) < first:
        seen |= {p["batchId"]: p["numInputRows"] for p in stream.recentProgress if p["numInputRows"]}
        if not stream.isActive or time.monotonic() > until:
            raise RuntimeError(f"the stream of rows stopped: {stream.exception()}")
        time.sleep(0.2)
    stream.stop()
    return spark.read.schema("event_id long, event_type string").parquet(path)


@query("a5_stream_watermark", f"""SELECT w.* FROM ({_WINDOW_SQL}) w
    WHERE strptime(w.window_start, '%Y-%m-%d %H:%M:%S') + INTERVAL '1 hour' <= (SELECT max(ts) - INTERVAL '30 seconds' FROM events)""")
def a5_stream_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream's windows in append mode: those that the watermark has passed, each once."""
    windows = analytics.windowed(table_stream(spark, sf_dir, "events"), "ts", ("event_type",), ("value",), "1 hour", watermark="30 seconds")
    path = shared_path(spark, "windows")
    write(windows, "parquet", path, checkpoint=shared_path(spark, "windows-log"), trigger={"availableNow": True}).awaitTermination()
    return _shown_windows(spark.read.schema(windows.schema).parquet(path))


# --- scalars ------------------------------------------------------------------------------

field(
    "g1_uuid",
    {"type": "uuid"},
    f"concat_ws('-', substr({hexes('v')},1,8), substr({hexes('v')},9,4), substr({hexes('v')},13,4), substr({hexes('v')},17,4), substr({hexes('v')},21,12))",
)
field("g10_timestamp_now", {"type": "timestamp"}, "TRUE", lambda: F.abs(F.unix_timestamp() - F.unix_timestamp("v")) < 3600)
field("g2_int", {"type": "int", "range": [-20, 80]}, f"CAST(trunc({u('v')}*100::DOUBLE + -20::DOUBLE) AS INT)")
field("g2_int_inclusive", {"type": "int", "range": [1, 6], "inclusive": True}, f"CAST(floor({u('v')}*6) + 1 AS INT)")
field("g3_long", {"type": "long", "range": [1000000000, 9999999999]}, f"CAST(trunc({u('v')}*8999999999::DOUBLE + 1000000000::DOUBLE) AS BIGINT)")
field("g4_short", {"type": "short", "range": [1, 100]}, f"CAST(trunc({u('v')}*99::DOUBLE + 1) AS SMALLINT)")
field("g5_byte", {"type": "byte"}, f"CAST(trunc({u('v')}*127::DOUBLE) AS TINYINT)")
field("g6_float", {"type": "float", "range": [3.0, 4.2]}, f"CAST({u('v')}*(4.2::DOUBLE-3.0::DOUBLE) + 3.0::DOUBLE AS FLOAT)")
field("g7_double", {"type": "double", "range": [-90.0, 90.0]}, f"{u('v')}*180::DOUBLE + -90::DOUBLE")
field("g8_decimal", {"type": "decimal", "range": [1.0, 999.99]}, f"CAST({u('v')}*(999.99::DOUBLE-1::DOUBLE) + 1::DOUBLE AS DECIMAL(10,2))")
field("g9_boolean", {"type": "boolean"}, f"{u('v')} < 0.5")
field(
    "g11_timestamp",
    {"type": "timestamp", "begin": "2024-01-01 00:00:00", "end": "2025-01-01 00:00:00"},
    f"CAST(1704067200 + floor({u('v')}*31622400) AS BIGINT)",
    lambda: F.unix_seconds("v"),
)
field("g12_date", {"type": "date"}, f"strftime(DATE '2020-01-01' + CAST(floor({u('v')}*1826) AS INT), '%Y-%m-%d')", lambda: F.col("v").cast("string"))
field("g13_binary_hex", {"type": "binary"}, f"upper({hexes('v')})", lambda: F.hex("v"))
field("g14_string_default", {"type": "string"}, "'value'")
field("g15_single", {"type": "string", "values": ["it's"]}, "'it''s'")
field("g16_equal_values", {"type": "string", "values": ["a", "b", "c"]}, f"['a','b','c'][CAST(floor({u('v')}*3) AS INT) + 1]")
field(
    "g17_weighted_values",
    {"type": "int", "values": [10, 20, 30], "weights": [5, 3, 2]},
    f"CASE WHEN {u('v')} < 5/10.0::DOUBLE THEN 10 WHEN {u('v')} < 8/10.0::DOUBLE THEN 20 ELSE 30 END",
)
field(
    "g18_weighted_list_with_nulls",
    {"type": "string", "values": ["x", "y"], "weights": [9, 1], "percent_nulls": 0.2},
    f"CASE WHEN {u('v','null')} >= 0.2::DOUBLE THEN CASE WHEN {u('v')} < 9/10.0::DOUBLE THEN 'x' ELSE 'y' END END",
)
field("g19_typed_literals", {"type": "decimal", "precision": 6, "scale": 3, "values": ["1.5", "22.125"]}, f"[1.5::DECIMAL(6,3), 22.125::DECIMAL(6,3)][CAST(floor({u('v')}*2) AS INT) + 1]")


@query("g20_expr", "SELECT event_id, upper(substr(event_type, 1, 3)) || '-' || (event_id % 7)::VARCHAR AS v FROM events")
def g20_expr(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = config({"v": {"type": "string", "expr": "concat(upper(substr(event_type, 1, 3)), '-', cast(event_id % 7 as string))"}})
    out = Generator(spark, c.spec()).apply(events(spark, sf_dir), "event_id", ("event_id", "event_type"))
    return out.select("event_id", "v")


def _name_sql() -> str:
    from driftloom.functions import text

    first, last = (str(list(map(str, x))) for x in (text._FIRST, text._LAST))
    return (
        f"{first}[CAST(floor({u('v','first')}*{len(text._FIRST)}) AS INT)+1] || ' ' || "
        f"{last}[CAST(floor({u('v','last')}*{len(text._LAST)}) AS INT)+1]"
    )


def _sentence_sql(n: int) -> str:
    from driftloom.functions import text

    words = str(list(map(str, text._WORD)))
    said = " || ' ' || ".join(f"{words}[CAST(floor({u('v', f'w{k}')}*{len(text._WORD)}) AS INT)+1]" for k in range(n))
    return f"upper(substr({said}, 1, 1)) || substr({said}, 2) || '.'"


field("g21_text_name", {"type": "string", "faker": "name"}, _name_sql())
field(
    "g21_text_sentence",
    {"type": "string", "faker": "sentence", "faker_args": {"nb_words": 8}},
    _sentence_sql(8),
)

# --- nested -------------------------------------------------------------------------------

_ITEMS = [f"CAST(trunc({u(f'v[{k}]')}*(10-5)::DOUBLE + 5) AS INT)" for k in range(5)]
field("n1_fixed_array", {"type": "array", "item_type": "int", "num_features": 3, "range": [5, 10]}, f"concat_ws(',', {', '.join(_ITEMS[:3])})", lambda: F.array_join("v", ","))
field(
    "n2_var_array",
    {"type": "array", "item_type": "int", "num_features": [1, 5], "range": [5, 10]},
    f"array_to_string(list_slice([{', '.join(_ITEMS)}], 1, CAST(floor({u('v','length')}*5) AS INT) + 1), ',')",
    lambda: F.array_join("v", ","),
)
field(
    "n3_weighted_elements",
    {"type": "array", "item_type": "string", "num_features": [2, 2], "values": ["a", "b"], "weights": [3, 1]},
    " || '-' || ".join(f"CASE WHEN {u(f'v[{k}]')} < 3/4.0::DOUBLE THEN 'a' ELSE 'b' END" for k in range(2)),
    lambda: F.array_join("v", "-"),
)
_STRUCT = {
    "type": "struct",
    "fields": {
        "city": {"type": "string", "values": ["Rome", "Oslo"]},
        "zip": {"type": "int", "range": [10000, 99999], "percent_nulls": 0.1},
        "at": {"type": "struct", "fields": {"lat": {"type": "double", "range": [25.0, 48.0]}, "tags": {"type": "array", "item_type": "string", "num_features": 2, "values": ["p", "q"]}}},
        "more": {"type": "map", "values": [{"k": "1"}, {"k": "2"}]},
    },
}


def _struct(name: str, show: dict[str, str], sql: dict[str, str]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return over_events(spark, sf_dir, config({"v": _STRUCT})).select("event_id", *(F.expr(e).alias(n) for n, e in show.items()))

    query(name, "SELECT event_id, " + ", ".join(f"{e} AS {n}" for n, e in sql.items()) + " FROM events")(run)


_struct(
    "n4_struct",
    {"city": "v.city", "zip": "v.zip"},
    {
        "city": f"['Rome','Oslo'][CAST(floor({u('v.city')}*2) AS INT)+1]",
        "zip": f"CASE WHEN {u('v.zip','null')} >= 0.1::DOUBLE THEN CAST(trunc({u('v.zip')}*89999::DOUBLE + 10000) AS INT) END",
    },
)
_struct(
    "n5_nested_struct",
    {"lat": "v.at.lat", "tags": "array_join(v.at.tags, ',')"},
    {
        "lat": f"{u('v.at.lat')}*(48::DOUBLE-25::DOUBLE) + 25::DOUBLE",
        "tags": f"['p','q'][CAST(floor({u('v.at.tags[0]')}*2) AS INT)+1] || ',' || ['p','q'][CAST(floor({u('v.at.tags[1]')}*2) AS INT)+1]",
    },
)
_struct("n8_map_in_struct", {"k": "v.more['k']"}, {"k": f"['1','2'][CAST(floor({u('v.more')}*2) AS INT)+1]"})
field(
    "n6_map",
    {"type": "map", "value_type": "int", "values": [{"a": 1, "b": 2}, {"a": 3}], "weights": [7, 3]},
    f"CASE WHEN {u('v')} < 7/10.0::DOUBLE THEN '1,2' ELSE '3,-' END",
    lambda: F.concat_ws(",", F.expr("cast(v['a'] as string)"), F.coalesce(F.expr("cast(v['b'] as string)"), F.lit("-"))),
)
field("n7_empty_map", {"type": "map"}, "0", lambda: F.size("v"))

# --- routing, quality, derived ------------------------------------------------------------

_ROUTED = [
    {"event_type_id": "a", "weight": 5, "fields": {"x": {"type": "int", "range": [0, 10]}, "s": {"type": "struct", "fields": {"n": {"type": "int", "range": [0, 5]}}}, "w": {"type": "string", "values": ["a-only"]}}},
    {"event_type_id": "b", "weight": 3, "fields": {"x": {"type": "int", "range": [100, 200]}, "s": {"type": "struct", "fields": {"n": {"type": "int", "range": [50, 55]}}}, "common": {"type": "string", "values": ["lost"]}}},
    {"event_type_id": "c", "weight": 2, "fields": {"x": {"type": "int", "range": [0, 10]}}},
]
_WHICH = f"CASE WHEN {u(TYPE_PATH)} < 5/10.0::DOUBLE THEN 'a' WHEN {u(TYPE_PATH)} < 8/10.0::DOUBLE THEN 'b' ELSE 'c' END"


def _routed(name: str, show: str, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = config({"kind": {"event_type_id": True}, "common": {"type": "string", "values": ["kept"]}}, _ROUTED)
        return over_events(spark, sf_dir, c).select("event_id", "kind", F.expr(show).alias("v"))

    query(name, f"SELECT event_id, kind, {sql} AS v FROM (SELECT event_id, {_WHICH} AS kind FROM events)")(run)


_routed(
    "r1_conditional",
    "x",
    f"CASE WHEN kind = 'b' THEN CAST(trunc({u('x@b')}*100::DOUBLE + 100) AS INT) ELSE CAST(trunc({u('x@a')}*10::DOUBLE) AS INT) END",
)
_routed(
    "r2_conditional_struct",
    "s.n",
    f"CASE kind WHEN 'a' THEN CAST(trunc({u('s@a.n')}*5::DOUBLE) AS INT) WHEN 'b' THEN CAST(trunc({u('s@b.n')}*5::DOUBLE + 50) AS INT) END",
)
_routed("r3_common_wins", "common", "'kept'")
_routed("r4_registry_order", "w", "CASE WHEN kind = 'a' THEN 'a-only' END")

_OUT = {
    "type": "int",
    "range": [0, 100],
    "outliers": [{"percent": 0.04, "expr": "-1"}, {"percent": 0.03, "expr": "-2"}, {"percent": 0.01, "expr": "-3"}],
}
_CORE = f"CAST(trunc({u('v')}*100::DOUBLE) AS INT)"
_TOTAL = 0.04 + 0.03 + 0.01
_OUT_SQL = (
    f"CASE WHEN {u('v','outlier')} < {_TOTAL!r}::DOUBLE THEN CASE WHEN {u('v','which')} < {(_TOTAL - 0.01 - 0.03) / _TOTAL!r}::DOUBLE THEN -1 "
    f"WHEN {u('v','which')} < {(_TOTAL - 0.01) / _TOTAL!r}::DOUBLE THEN -2 ELSE -3 END ELSE {_CORE} END"
)
field("q1_outliers", _OUT, _OUT_SQL)
field("q2_nulls", {"type": "int", "range": [0, 100], "percent_nulls": 0.3}, f"CASE WHEN {u('v','null')} >= 0.3::DOUBLE THEN {_CORE} END")
field("q1q2_layered", _OUT | {"percent_nulls": 0.1}, f"CASE WHEN {u('v','null')} >= 0.1::DOUBLE THEN {_OUT_SQL} END")
field(
    "q3_container_nulls",
    {"type": "array", "item_type": "int", "num_features": 1, "range": [0, 10], "percent_nulls": 0.25, "outliers": [{"percent": 0.1, "expr": "array(-9)"}]},
    f"CASE WHEN {u('v','null')} >= 0.25::DOUBLE THEN CASE WHEN {u('v','outlier')} < 0.1::DOUBLE THEN -9 ELSE CAST(trunc({u('v[0]')}*10::DOUBLE) AS INT) END END",
    lambda: F.col("v")[0],
)


@query(
    "d1_derived",
    f"""WITH b AS (SELECT event_id, CAST(trunc({u('n')}*9::DOUBLE + 1) AS INT) AS n, ['p','q'][CAST(floor({u('s')}*2) AS INT)+1] AS s FROM events)
    SELECT event_id, n * 2 AS twice, s || '/' || (n * 2)::VARCHAR AS label, length(s || '/' || (n * 2)::VARCHAR)::INT AS size FROM b""",
)
def d1_derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = config(
        {"n": {"type": "int", "range": [1, 10]}, "s": {"type": "string", "values": ["p", "q"]}},
        derived={
            "twice": {"type": "int", "expr": "n * 2"},
            "label": {"type": "string", "expr": "concat(s, '/', cast(twice as string))", "base_columns": ["s", "twice"]},
            "size": {"type": "int", "expr": "length(label)"},
        },
    )
    return over_events(spark, sf_dir, c).select("event_id", "twice", "label", "size")


@query(
    "d2_expression_idioms",
    """SELECT event_id, lpad((user_id % 100000)::VARCHAR, 8, '0') AS padded, strftime(ts, '%Y-%m-%d') AS day,
    floor(epoch(ts + to_seconds(CAST(event_id % 300 AS INTEGER))))::BIGINT AS later, replace(event_type, 'i', '') AS squeezed FROM events""",
)
def d2_expression_idioms(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    later = e.withColumn("later", F.expr("ts + make_interval(0, 0, 0, 0, 0, 0, event_id % 300)"))
    return later.select(
        "event_id",
        F.lpad((F.col("user_id") % 100000).cast("string"), 8, "0").alias("padded"),
        F.date_format("ts", "yyyy-MM-dd").alias("day"),
        seconds("later").alias("later"),
        F.replace("event_type", F.lit("i"), F.lit("")).alias("squeezed"),
    )


@query("d3_type_filter", f"SELECT event_id, kind FROM (SELECT event_id, {_WHICH} AS kind FROM events) WHERE kind IN ('a', 'c')")
def d3_type_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = over_events(spark, sf_dir, config({"kind": {"event_type_id": True}}, _ROUTED))
    return analytics.only(wide, "kind", ("a", "c")).select("event_id", "kind")


# --- envelopes and consumers --------------------------------------------------------------

_PAYLOAD = "json_merge_patch('{}', to_json({'event_id': event_id, 'event_name': event_name, 'x': x}))::VARCHAR"
_ENVELOPED = f"""(SELECT event_id, {_WHICH} AS event_name, CASE WHEN {_WHICH} = 'b' THEN CAST(trunc({u('x@b')}*100::DOUBLE + 100) AS INT)
    WHEN {_WHICH} = 'a' THEN CAST(trunc({u('x@a')}*10::DOUBLE) AS INT) END AS x FROM events)"""
_ENVELOPED_TYPES = [{k: v for k, v in e.items() if k != "fields"} | {"fields": {n: f for n, f in e["fields"].items() if n == "x" and e["event_type_id"] != "c"}} for e in _ROUTED]


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return over_events(spark, sf_dir, config({"event_name": {"event_type_id": True}}, _ENVELOPED_TYPES))


@query("j1_wide", f"SELECT event_id, event_name, x FROM {_ENVELOPED}")
def j1_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wide(spark, sf_dir)


@query("j2_envelope", f"SELECT event_name AS partition_key, {_PAYLOAD} AS data FROM {_ENVELOPED}")
def j2_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return envelope.envelope(_wide(spark, sf_dir), "event_name")


@query("j2_round_trip", f"SELECT event_id, event_name, x FROM {_ENVELOPED}")
def j2_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = _wide(spark, sf_dir)
    return envelope.from_envelope(envelope.envelope(wide, "event_name"), wide.schema)


@query(
    "j3_timestamp_backfill",
    """SELECT event_id::VARCHAR AS event_id, TRUE AS stamped_now, CAST(strftime(ts, '%Y-%m-%d %H:%M:%S') AS VARCHAR) AS own_time FROM events""",
)
def j3_timestamp_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables without a timestamp get the present one; a table that has ``event_timestamp`` keeps it."""
    spec = config({"event_name": {"event_type_id": True}}, sink_config={"type": "kinesis", "partition_key_field": "event_name"}).spec()
    read = events(spark, sf_dir).select("event_id", F.lit("only").alias("event_name"), F.col("ts").alias("event_timestamp"))
    data = lambda df: analytics.parse(envelope.to_envelope(df, spec)).select("event_id", "event_timestamp")
    age = F.unix_timestamp(F.current_timestamp()) - F.unix_timestamp("event_timestamp")
    now = data(read.drop("event_timestamp")).select("event_id", F.abs(age).between(0, 3600).alias("stamped_now"))
    own = data(read).select("event_id", F.date_format("event_timestamp", "yyyy-MM-dd HH:mm:ss").alias("own_time"))
    return now.join(own, "event_id")


@query(
    "a2_event_time",
    """SELECT event_id::VARCHAR AS event_id, event_type AS event_name, user_id::VARCHAR AS event_key, floor(epoch(ts))::BIGINT AS seconds FROM events""",
)
def a2_event_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The payload's time as a timestamp again."""
    e = events(spark, sf_dir)
    wide = e.select("event_id", F.col("event_type").alias("event_name"), F.col("user_id").alias("event_key"), F.col("ts").alias("event_timestamp"))
    parsed = analytics.parse(envelope.envelope(wide, "event_key"))
    return parsed.select("event_id", "event_name", "event_key", F.unix_seconds("event_timestamp").alias("seconds"))


@query("a1_parse_payload", f"SELECT event_name, event_id::VARCHAR AS event_id, {_PAYLOAD} AS payload FROM {_ENVELOPED}")
def a1_parse_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.parse(envelope.envelope(_wide(spark, sf_dir), "event_name")).select("event_name", "event_id", "payload")


@query("a1_parse_props", """SELECT event_id, json_extract_string(props, '$.k')::INT AS k FROM events""")
def a1_parse_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return envelope.extract(events(spark, sf_dir), {"k": "int"}, data="props", keep=("event_id",))


@query(
    "a3_latency",
    """SELECT event_type, count(*) AS n, sum(event_id % 120)::BIGINT AS e2e, sum(event_id % 120 - event_id % 60)::BIGINT AS arrival
    FROM events GROUP BY 1""",
)
def a3_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("ts", F.timestamp_seconds(seconds("ts")))
    times = e.withColumns({n: F.timestamp_seconds(F.unix_seconds("ts") + F.col("event_id") % k) for n, k in (("arrived", 60), ("read", 120))})
    out = analytics.with_latency(times, "ts", "arrived", "read")
    return out.groupBy("event_type").agg(
        F.count("*").alias("n"), F.sum("e2e_latency_seconds").alias("e2e"), F.sum("arrival_latency_seconds").alias("arrival")
    )


@query(
    "a6_tumbling",
    """SELECT strftime(time_bucket(INTERVAL '10 seconds', ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS event_count
    FROM events GROUP BY 1""",
)
def a6_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = analytics.windowed(events(spark, sf_dir), "ts", (), (), "10 seconds", watermark=None)
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_count")


@query("a7_window_stats", _WINDOW_SQL)
def a7_window_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown_windows(analytics.windowed(events(spark, sf_dir), "ts", ("event_type",), ("value",), "1 hour", watermark=None))


@query(
    "a8_latest_windows",
    f"SELECT window_start, event_type, event_count FROM ({_WINDOW_SQL}) ORDER BY window_start DESC",
)
def a8_latest_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.latest_first(a7_window_stats(spark, sf_dir)).select("window_start", "event_type", "event_count")


@query(
    "a9_percentiles",
    """SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95,
    round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1""",
)
def a9_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = analytics.percentiles(events(spark, sf_dir), "value", ("event_type",), exact=True)
    return out.select("event_type", *(F.round(c, 6).alias(c) for c in ("p50", "p95", "p99")))


@query(
    "a9_approximate_percentiles",
    "SELECT event_type, TRUE AS p50_in_bounds, TRUE AS p95_in_bounds, TRUE AS p99_in_bounds FROM events GROUP BY 1",
)
def a9_approximate_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the ranks of the approximate percentiles are within their bound of the true ones."""
    e = events(spark, sf_dir)
    near = analytics.percentiles(e, "value", ("event_type",))
    bound = 1 / 10_000

    def fits(name: str, p: float) -> Column:
        # a group of n rows has ranks in steps of 1 / n
        below, upto = (F.count_if(c) / F.count("*") for c in (F.col("value") < F.col(name), F.col("value") <= F.col(name)))
        step = 1 / F.count("*")
        return ((below <= p + bound + step) & (upto >= p - bound - step)).alias(f"{name}_in_bounds")

    return e.join(near, "event_type").groupBy("event_type").agg(*(fits(n, p) for n, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))))


_SHARES = {"click": 3, "view": 3, "purchase": 2, "signup": 1, "error": 1}


@query(
    "a10_distribution",
    """SELECT event_type, count(*) AS rows, round(count(*)/sum(count(*)) OVER (), 9) AS share,
    CASE event_type WHEN 'click' THEN 0.3 WHEN 'view' THEN 0.3 WHEN 'purchase' THEN 0.2 ELSE 0.1 END::DOUBLE AS expected FROM events GROUP BY 1""",
)
def a10_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = analytics.distribution(events(spark, sf_dir), "event_type", _SHARES)
    return out.select("event_type", "rows", F.round("share", 9).alias("share"), "expected")


_HOURLY = """(SELECT event_type, epoch(date_trunc('hour', ts))::BIGINT AS second, count(*)::DOUBLE AS n FROM events GROUP BY ALL)"""


def _hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each type and hour, the measured load of a pipeline."""
    second = (F.floor(seconds("ts") / 3600) * 3600).alias("second")
    return events(spark, sf_dir).groupBy("event_type", second).agg(F.count("*").cast("double").alias("n"))


@query(
    "a11_health",
    f"""WITH p AS (SELECT event_type, second, n AS input_rate, 4 + second // 3600 % 3 AS processing_rate FROM {_HOURLY})
    SELECT event_type, second, CASE WHEN processing_rate < input_rate THEN 'backlog_growing' WHEN input_rate / processing_rate > 1 THEN 'over_trigger'
      WHEN input_rate / processing_rate > 0.8 THEN 'near_trigger' ELSE 'healthy' END AS state FROM p""",
)
def a11_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each hour's load of each type against what a pipeline gets through, which changes by the hour."""
    rows = _hourly(spark, sf_dir).select(
        "event_type", "second", F.col("n").alias("input_rate"), (4 + F.floor(F.col("second") / 3600) % 3).cast("double").alias("processing_rate")
    )
    rows = rows.withColumn("batch_seconds", F.col("input_rate") / F.col("processing_rate"))
    return analytics.health(rows, 1.0).select("event_type", "second", "state")


@query(
    "a12_actions",
    """SELECT user_id % 2 = 0 AS backlog_growing, CASE WHEN user_id % 2 <> 0 THEN 'healthy' WHEN event_id % 11 = 0 THEN 'split_pipeline'
    WHEN event_id % 100 > 80 THEN 'scale_out' WHEN event_id % 10 = 9 THEN 'scale_up' WHEN event_id % 7 = 6 THEN 'optimize_shuffle'
    ELSE 'check_skew_source_sink_code' END AS action, count(*) AS n FROM events GROUP BY 1, 2""",
)
def a12_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select(
        (F.col("user_id") % 2 == 0).alias("backlog_growing"),
        (F.col("event_id") % 11 == 0).alias("mixed"),
        ((F.col("event_id") % 100) / 100).alias("cpu_min"),
        F.when(F.col("event_id") % 10 == 9, 0.9).otherwise(0.5).alias("memory"),
        F.lit(0.01).alias("gc"),
        F.when(F.col("event_id") % 7 == 6, 0.9).otherwise(0.1).alias("network"),
    )
    return e.groupBy("backlog_growing", sizing.action().alias("action")).agg(F.count("*").alias("n"))


@query(
    "a13_cost",
    "SELECT o_orderstatus, round(12.0/(count(*)*3600/1e6), 9) AS dollars FROM orders GROUP BY 1",
)
def a13_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_orderstatus").agg(F.count("*").alias("rate"))
    return orders.select("o_orderstatus", F.round(sizing.cost_per_million(F.lit(12.0), F.col("rate")), 9).alias("dollars"))


@query(
    "a14_breaking_point",
    """WITH s AS (SELECT hour(ts) AS step, count(*)::DOUBLE AS input_rate FROM events GROUP BY 1),
    m AS (SELECT *, least(1.2 * input_rate, 0.97 * max(input_rate) OVER ()) AS processing_rate FROM s)
    SELECT max(processing_rate)::DOUBLE AS max_rate, max(CASE WHEN (processing_rate-input_rate)/input_rate >= 0.05 THEN input_rate END)::DOUBLE AS capacity,
    min(CASE WHEN processing_rate < input_rate THEN input_rate END)::DOUBLE AS breaking_rate FROM m""",
)
def a14_breaking_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours of the day as load steps, for a pipeline that gets through a fifth more than comes, up to a limit."""
    steps = events(spark, sf_dir).groupBy(F.hour("ts").alias("step")).agg(F.count("*").cast("double").alias("input_rate"))
    limit = F.lit(0.97) * steps.agg(F.max("input_rate")).scalar()
    return sizing.breaking_point(steps.withColumn("processing_rate", F.least(1.2 * F.col("input_rate"), limit)))


@query(
    "a15_burst_backlog",
    f"""WITH c AS (SELECT event_type, second, n AS rate, sum((n - 3.0) * 3600) OVER (PARTITION BY event_type ORDER BY second) AS total FROM {_HOURLY})
    SELECT event_type, second, rate, (total - least(0, min(total) OVER (PARTITION BY event_type ORDER BY second)))::DOUBLE AS backlog FROM c""",
)
def a15_burst_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left over at the end of each hour if a pipeline of each type gets through three rows an hour."""
    load = _hourly(spark, sf_dir).withColumnRenamed("n", "rate")
    return sizing.backlog(load, 3.0, 3600.0, ("event_type",))


@query(
    "a16_skew",
    """WITH c AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1)
    SELECT count(*) AS keys, sum(n)::BIGINT AS rows, max(n) AS largest, round(avg(n), 9) AS average, round(max(n)/avg(n), 9) AS ratio FROM c""",
)
def a16_skew(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.skew(events(spark, sf_dir), "user_id").select(
        "keys", "rows", "largest", F.round("average", 9).alias("average"), F.round("ratio", 9).alias("ratio")
    )


@query(
    "a17_fanout_groups",
    "SELECT c_name, CAST(floor((row_number() OVER (ORDER BY c_name) - 1)/50) AS INT) AS pipeline FROM (SELECT DISTINCT c_name FROM customer)",
)
def a17_fanout_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.fan_out(spark.read.parquet(f"{sf_dir}/customer.parquet"), "c_name")


# --- sinks --------------------------------------------------------------------------------


def _written(spark: SparkSession, df: DataFrame, fmt: str, **options: Any) -> DataFrame:
    """A table written by a sink and read back."""
    path = shared_path(spark, "sink")
    write(df, fmt, path, **options)
    reader = spark.read.schema(df.schema)
    return (reader.option("header", "true") if fmt == "csv" else reader).format(fmt).load(path).select(*df.columns)


@query("k10_parquet", f"SELECT event_id, event_name, x FROM {_ENVELOPED}")
def k10_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _written(spark, _wide(spark, sf_dir), "parquet", partition_by=("event_name",), maxRecordsPerFile=5000, compression="zstd")


@query("k11_json", f"SELECT event_id, event_name, x FROM {_ENVELOPED}")
def k11_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _written(spark, _wide(spark, sf_dir), "json", compression="gzip")


@query("k12_csv", f"SELECT event_id, event_name, x FROM {_ENVELOPED}")
def k12_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _written(spark, _wide(spark, sf_dir), "csv", header="true")


_TWICE = f"""SELECT event_id, event_name, x, NULL::VARCHAR AS source FROM {_ENVELOPED}
    UNION ALL SELECT event_id, event_name, x, 'second' AS source FROM {_ENVELOPED}"""


@query("k9_merged_appends", _TWICE)
def k9_merged_appends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A partitioned sink that is appended to twice, the second time with a further column."""
    path, wide = shared_path(spark, "merged"), _wide(spark, sf_dir)
    for rows in (wide, wide.withColumn("source", F.lit("second"))):
        write(rows, "parquet", path, partition_by=("event_name",))
    return read_merged(spark, path).select("event_id", F.col("event_name").cast("string"), "x", "source")


@query("k9_catalog_table", f"SELECT event_id, event_name, x FROM {_ENVELOPED}")
def k9_catalog_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of the catalog, by its name."""
    path = shared_path(spark, "catalog")
    name = f"driftloom_{path[-32:]}"
    write(_wide(spark, sf_dir), "parquet", path, partition_by=("event_name",), table=name)
    return spark.table(name).select("event_id", "event_name", "x")


_SENT = {"stream_name": "s", "client_factory": record_files.FACTORY}
_RECORDS = "partition_key string, data string"


@query("k1_record_batch", f"SELECT event_name AS partition_key, {_PAYLOAD} AS data FROM {_ENVELOPED}")
def k1_record_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All envelopes through the record sink, to a client that keeps them."""
    spark.dataSource.register(RecordSink)
    path = shared_path(spark, "records")
    write(j2_envelope(spark, sf_dir), RecordSink.name(), records_path=path, **_SENT)
    return spark.read.schema(_RECORDS).json(path)


@query("k1_record_stream", f"SELECT event_name AS partition_key, {_PAYLOAD} AS data FROM {_ENVELOPED}")
def k1_record_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a stream, a replay of envelopes from files."""
    spark.dataSource.register(RecordSink)
    path, kept = shared_path(spark, "records"), shared_path(spark, "envelopes")
    write(j2_envelope(spark, sf_dir), "parquet", kept)
    log = shared_path(spark, "records-log")
    replay = envelope_stream(spark, kept, files_per_batch=1)
    write(replay, RecordSink.name(), checkpoint=log, trigger={"availableNow": True}, records_path=path, **_SENT).awaitTermination()
    return spark.read.schema(_RECORDS).json(path)


@query("k15_checkpoint", "SELECT event_id FROM events")
def k15_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream that is started again with its checkpoint adds nothing twice."""
    path, log = shared_path(spark, "stream"), shared_path(spark, "stream-log")
    for _ in range(2):
        stream = table_stream(spark, sf_dir, "events").select("event_id")
        write(stream, "parquet", path, checkpoint=log, trigger={"availableNow": True}).awaitTermination()
    return spark.read.schema("event_id long").parquet(path)


@query("a18_progress", "SELECT count(*) AS input_rows, TRUE AS timed FROM events")
def a18_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress rows of a stream say what it has read and how long that took."""
    stream = table_stream(spark, sf_dir, "events").select("event_id")
    with ProgressLog(spark) as log:
        started = write(stream, "noop", checkpoint=shared_path(spark, "progress-log"), trigger={"availableNow": True})
        started.awaitTermination()
        return log.progress(started).agg(F.sum("input_rows").alias("input_rows"), (F.min("batch_seconds") > 0).alias("timed"))


@query("s6_record_reader", f"SELECT event_name AS partition_key, {_PAYLOAD} AS data FROM {_ENVELOPED}")
def s6_record_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Envelopes sent to a stream of four shards and read from it, with a restart between two halves."""
    spark.dataSource.register(RecordSink)
    sent, out, log = (shared_path(spark, n) for n in ("shards", "shards-out", "shards-log"))
    options = _SENT | {"records_path": sent, "records_shards": "4"}
    rows = j2_envelope(spark, sf_dir).withColumn("half", F.crc32("data") % 2)
    for half in range(2):
        write(rows.filter(F.col("half") == half).drop("half"), RecordSink.name(), **options)
        reader = spark.readStream.format(RecordSink.name()).options(**options, settle_seconds="0")
        time.sleep(0.01)  # what arrives in a batch's last millisecond belongs to the next one
        write(reader.load(), "parquet", out, checkpoint=log, trigger={"availableNow": True}).awaitTermination()
    return spark.read.schema(_RECORDS).parquet(out)


@query("k8_kafka_columns", f"SELECT event_name AS key, {_PAYLOAD} AS value FROM {_ENVELOPED}")
def k8_kafka_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return for_kafka(j2_envelope(spark, sf_dir))


# --- rules of specifications --------------------------------------------------------------

_SOUND: dict[str, Any] = {
    "generation_mode": "batch",
    "batch_config": {"total_rows": 10},
    "sink_config": {"type": "kinesis", "partition_key_field": "key"},
    "common_fields": {
        "event_name": {"event_type_id": True},
        "key": {"type": "string", "values": ["a", "b"], "weights": [1, 2]},
        "place": {"type": "struct", "fields": {"lat": {"type": "double"}, "who": {"type": "string", "faker": "name"}}},
    },
    "event_types": [
        {"event_type_id": "x", "weight": 2, "fields": {"n": {"type": "int"}, "m": {"type": "map", "values": [{"a": "b"}]}}},
        {"event_type_id": "y", "weight": 1, "fields": {"n": {"type": "int"}, "l": {"type": "array", "item_type": "int"}}},
    ],
    "derived_fields": {"twice": {"type": "int", "expr": "n * 2"}},
}
#: A change of the sound document for each rule that must reject it; "-" removes the key.
_BREAKS: dict[str, tuple[str, Any]] = {
    "sound": ("seed", 7),
    "V1 event types": ("event_types", "-"),
    "V1 one type at least": ("event_types", []),
    "V1 mode": ("generation_mode", "-"),
    "V1 sink": ("sink_config", "-"),
    "V2 weight": ("event_types/0/weight", 0.6),
    "V3 unique types": ("event_types/1/event_type_id", "x"),
    "V4 whole weights of values": ("common_fields/key/weights", [0.2, 0.8]),
    "V5 mode is known": ("generation_mode", "micro"),
    "V6 settings of the mode": ("batch_config", "-"),
    "V7 derived type and expression": ("derived_fields/twice", {"type": "int"}),
    "V8 types are known": ("common_fields/key/type", "text"),
    "V9 outliers": ("common_fields/key/outliers", [{"percent": 1.0, "expr": "1"}]),
    "V10 nulls": ("common_fields/key/percent_nulls", 1.0),
    "V11 nulls inside structs": ("common_fields/place/fields/lat/percent_nulls", 7),
    "V11 outliers inside structs": ("common_fields/place/fields/lat/outliers", [{"percent": 2, "expr": "1"}]),
    "V12 one type across event types": ("event_types/1/fields/n/type", "long"),
    "V13 text is of strings": ("event_types/0/fields/n/faker", "name"),
    "V13 text excludes values": ("common_fields/place/fields/who/values", ["a"]),
    "V14 reserved names": ("common_fields/__row_id", {"type": "int"}),
    "V15 discriminator is common": ("event_types/0/fields/kind", {"event_type_id": True}),
    "V15 discriminator has no values": ("common_fields/event_name/values", ["a"]),
    "V16 key is a field": ("sink_config/partition_key_field", "absent"),
    "J4 payload format": ("serialization_format", "protobuf"),
}


def _broken(path: str, value: Any) -> str:
    """The sound document with one change, as JSON."""
    document = copy.deepcopy(_SOUND)
    at: Any = document
    *way, last = path.split("/")
    for p in way:
        at = at[int(p) if isinstance(at, list) else p]
    if value == "-":
        del at[last]
    else:
        at[last] = value
    return json.dumps(document)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document for each customer: of all changes one after another, with the customer's own names in it."""
    made = F.array(*(F.lit(_broken(*change)) for change in _BREAKS.values()))
    names = F.array(*map(F.lit, _BREAKS))
    number = (F.col("c_custkey") % len(_BREAKS) + 1).cast("int")
    own = F.replace(F.element_at(made, number), F.lit('"x"'), F.concat(F.lit('"x'), F.col("c_custkey").cast("string"), F.lit('"')))
    own = F.replace(own, F.lit('"kinesis"'), F.concat(F.lit('"'), F.col("c_mktsegment"), F.lit('"')))
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return customers.select("c_custkey", "c_mktsegment", F.element_at(names, number).alias("rule"), own.alias("document"))


_RULES = "list_value(" + ", ".join(repr(r) for r in _BREAKS) + f")[c_custkey % {len(_BREAKS)} + 1]"


@query("v_rules", f"SELECT c_custkey, {_RULES} AS rule, {_RULES} <> 'sound' AS rejected FROM customer")
def v_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each rule with documents that break just it, and sound ones, which pass: a document for each customer."""
    checked = documents.check_documents(_documents(spark, sf_dir), "document")
    return checked.select("c_custkey", "rule", (~F.col("valid")).alias("rejected"))


@query(
    "v17_mapping",
    f"""SELECT c_custkey, c_mktsegment AS dotted, 'batch' AS item, NULL::VARCHAR AS absent, '2' AS weight, 'x' || c_custkey AS first_type
    FROM customer WHERE {_RULES} = 'sound'""",
)
def v17_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid documents read like mappings, with dotted paths."""
    sound = _documents(spark, sf_dir).filter("rule = 'sound'")
    read = documents.read_documents(sound, "document", {"dotted": "sink_config.type", "item": "generation_mode", "absent": "batch_config.none", "types": "event_types"})
    first = F.from_json("types", "array<struct<event_type_id:string,weight:string>>")[0]
    return read.select("c_custkey", "dotted", "item", "absent", first["weight"].alias("weight"), first["event_type_id"].alias("first_type"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
