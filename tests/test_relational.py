"""Joins, windows, state and sets: nulls, ties, empty tables, keys with most rows, and plans."""

import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest
from driftloom.operators import grouping, joins, multisets, windows
from driftloom.plans import relational
from driftloom.streaming import stateful
from pyspark.sql import Row
from pyspark.sql import functions as F

T0 = datetime(2024, 1, 1)


def at(minutes):
    return None if minutes is None else T0 + timedelta(minutes=minutes)


def plan(df):
    return df._jdf.queryExecution().toString()


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# --- as-of ---------------------------------------------------------------------------------


def asof_plain(left, right, within=None):
    out = []
    for i, k, t in left:
        found = [r for r in right if None not in (k, t, r[0], r[1]) and r[0] == k and r[1] <= t]
        best = max(found, key=lambda r: (r[1], r[2] is not None, r[2] or 0), default=None)
        if best is not None and within is not None and best[1] < t - within:
            best = None
        out.append((i, k, t, best[2] if best else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot_rows", [5, 1000])
def test_asof_equals_plain(spark, hot_rows):
    rng = random.Random(1)
    time = lambda: rng.choice([None, *range(30), *range(30)])
    key = lambda: rng.choice([None, 1, 1, 1, 1, 2, 3])
    left = [(i, key(), time()) for i in range(120)] + [(0, 1, 5), (0, 1, 5)]
    right = [(key(), time(), rng.choice([None, 1, 2, 3])) for _ in range(60)]
    a = spark.createDataFrame(left, "i int, k int, t int")
    b = spark.createDataFrame(right, "k int, since int, v int")
    assert rows(joins.asof(a, b, ("k",), "t", "since", ("v",), hot_rows=hot_rows)) == asof_plain(left, right)
    empty = spark.createDataFrame([], b.schema)
    assert rows(joins.asof(a, empty, ("k",), "t", "since", ("v",), hot_rows=hot_rows)) == asof_plain(left, [])
    assert rows(joins.asof(a.limit(0), b, ("k",), "t", "since", ("v",), hot_rows=hot_rows)) == []


def test_asof_takes_the_ranges_of_a_hot_key_once(spark):
    """Quantiles that are taken again in another branch may be others, and carry wrong rows into a range."""
    a = spark.range(100).selectExpr("id as i", "id % 2 as k", "id as t")
    b = spark.range(100).selectExpr("id % 2 as k", "id as since", "id as v")
    joined = joins.asof(a, b, ("k",), "t", "since", ("v",), hot_rows=5)
    assert "percentile" not in plan(joined)
    assert all(r.v == r.i for r in joined.collect())


def test_asof_within_a_time(spark):
    left, right = [(1, 1, 10), (2, 1, 12), (3, 1, 5)], [(1, 5, 7)]
    a = spark.createDataFrame([(i, k, at(t)) for i, k, t in left], "i int, k int, t timestamp")
    b = spark.createDataFrame([(k, at(t), v) for k, t, v in right], "k int, since timestamp, v int")
    got = {r.i: r.v for r in joins.asof(a, b, ("k",), "t", "since", ("v",), within="6 minutes").collect()}
    assert got == {1: 7, 2: None, 3: 7}


def test_asof_has_no_join_of_rows_for_even_keys(spark):
    a = spark.range(100).selectExpr("id as i", "id % 5 as k", "id as t")
    b = spark.range(100).selectExpr("id % 5 as k", "id as since", "id as v")
    text = plan(joins.asof(a, b, ("k",), "t", "since", ("v",)))
    assert "Join" not in text and text.split("== Physical Plan ==")[1].count("Exchange") == 1


def test_asof_names(spark):
    a = spark.range(3).selectExpr("id as k", "id as t", "id as v")
    with pytest.raises(ValueError, match="both sides"):
        joins.asof(a, a, ("k",), "t", "t", ("v",))


# --- intervals -----------------------------------------------------------------------------


def test_intervals_equal_plain(spark):
    rng = random.Random(2)
    spans = [(i, rng.choice([None, 1, 1, 2]), a, a + rng.choice([-1, 0, 1, 7, 8, 9, 64, 5000, 1 << 40])) for i, a in enumerate(rng.randint(-400, 400) for _ in range(80))]
    spans += [(90, 1, None, 5), (91, 1, 5, None), (92, 1, -(1 << 61), 1 << 61)]
    points = [(i, rng.choice([None, 1, 1, 1, 2]), rng.choice([None, rng.randint(-420, 420)])) for i in range(150)] + [(0, 1, 3)] * 2
    a = spark.createDataFrame(points, "i int, k int, p long")
    b = spark.createDataFrame(spans, "j int, k int, a long, b long")
    hits = [(i, k, p, j) for i, k, p in points for j, m, lo, hi in spans if None not in (k, p, m, lo, hi) and k == m and lo <= p < hi]
    got = joins.within_intervals(a, b, "p", "a", "b", ("k",)).select("i", "k", "p", "j")
    assert rows(got) == sorted(hits, key=str)
    alone = [(*x, None) for x in points if not any(x[:3] == h[:3] for h in hits)]
    got = joins.within_intervals(a, b, "p", "a", "b", ("k",), how="left").select("i", "k", "p", "j")
    assert rows(got) == sorted(hits + alone, key=str)
    assert rows(joins.within_intervals(a, b.limit(0), "p", "a", "b", ("k",))) == []
    assert joins.within_intervals(a.limit(0), b, "p", "a", "b", ("k",), "left").count() == 0


@pytest.mark.parametrize("keys", [(), ("k",)])
def test_interval_totals_equal_plain(spark, keys):
    rng = random.Random(5)
    spans = [(i, rng.choice([None, 1, 1, 2]), a, a + rng.choice([-1, 0, 1, 7, 64, 5000])) for i, a in enumerate(rng.randint(-400, 400) for _ in range(80))]
    spans += [(90, 1, None, 5), (91, 1, 5, None), (92, 1, -(1 << 61), 1 << 61), (92, 1, -(1 << 61), 1 << 61)]
    points = [(rng.choice([None, 1, 1, 2]), rng.choice([None, rng.randint(-420, 420)]), rng.choice([None, rng.randint(-9, 9)])) for _ in range(150)] * 2
    a, b = spark.createDataFrame(points, "k int, p long, v int"), spark.createDataFrame(spans, "j int, k int, a long, b long")
    same = lambda k, m: not keys or (k is not None and k == m)
    want = []
    for j, m, lo, hi in spans:
        held = [v for k, p, v in points if None not in (p, lo, hi) and same(k, m) and lo <= p < hi]
        want.append((j, m, lo, hi, len(held), sum(v or 0 for v in held)))
    sums = {"n": F.lit(1), "total": F.col("v")}
    assert rows(joins.interval_totals(a, b, "p", "a", "b", sums, keys)) == sorted(want, key=str)
    none = [(*s, 0, 0) for s in spans]
    assert rows(joins.interval_totals(a.limit(0), b, "p", "a", "b", sums, keys)) == sorted(none, key=str)
    assert rows(joins.interval_totals(a, b.limit(0), "p", "a", "b", sums, keys)) == []
    with pytest.raises(ValueError, match="decimals"):
        joins.interval_totals(a, b, "p", "a", "b", {"x": F.col("v") / 2}, keys)


def test_interval_totals_make_no_pairs(spark, tmp_path):
    """No step of the query has more rows than times and intervals, though each interval holds most points."""
    made = spark.range(4000).selectExpr(
        "id * 97 as event_id", "timestamp_seconds(id) as ts", "1L as user_id", "IF(id % 2 = 0, 'error', 'purchase') as event_type", "IF(id = 3999, double('NaN'), 0.1D) as value"
    )
    made.write.parquet(f"{tmp_path}/events.parquet")
    got = relational.t3_interval_bins(spark, str(tmp_path))
    assert {r.error_id // 97: r.purchases for r in got.collect()} == {i: 2000 - i // 2 for i in range(0, 4000, 2)}
    assert all(r.spent != r.spent for r in got.collect())
    made.filter("NOT isnan(value)").write.parquet(f"{tmp_path}/sound/events.parquet")
    got = relational.t3_interval_bins(spark, f"{tmp_path}/sound")
    assert {r.error_id // 97: r.spent for r in got.collect()} == {i: round((1999 - i // 2) / 10, 4) for i in range(0, 4000, 2)}
    assert "bin_size" not in plan(got)


def test_intervals_are_an_equi_join(spark):
    a, b = spark.range(100).selectExpr("id as p"), spark.range(100).selectExpr("id as a", "id + 5 as b")
    text = plan(joins.within_intervals(a, b, "p", "a", "b"))
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_long_intervals_stay_few_rows(spark):
    """An interval is dealt to two bins at most, whatever its length."""
    a, b = spark.range(1).selectExpr("id as p"), spark.range(50).selectExpr("id as a", "id + (1 << (id % 40)) as b")
    joined = joins.within_intervals(a, b, "p", "a", "b")
    made = [n for n in plan(joined).split("\n") if "Generate explode(sequence" in n]
    assert made
    assert joined.count() == 1


# --- heavy keys ----------------------------------------------------------------------------


def test_split_join_equals_the_plain_one(spark):
    rng = random.Random(3)
    left = [(i % 150, 7 if i % 3 == 0 else rng.choice([None, *range(40)])) for i in range(300)]
    right = [(k, k * 10) for k in range(0, 60, 2)] + [(7, 1), (7, 2), (None, 5)]
    a, b = spark.createDataFrame(left, "i int, k int"), spark.createDataFrame(right, "k int, v int")
    assert [r.k for r in joins.heavy_keys(a, "k", 50).collect()] == [7]
    for how in ("inner", "left", "left_semi", "left_anti"):
        got = joins.split_join(a, b, "k", how, hot_rows=50, parts=4)
        want = a.join(b, "k", how)
        assert rows(got.select(*want.columns)) == rows(want)
        assert rows(joins.split_join(a.limit(0), b, "k", how)) == []
        assert got.columns == want.columns
    assert rows(joins.split_join(a, b.limit(0), "k", "left_anti", 50).select("k", "i")) == rows(a.select("k", "i"))
    with pytest.raises(ValueError, match="repeat"):
        joins.split_join(a, b, "k", "full")


def test_a_total_of_no_lines_is_a_row(spark, tmp_path):
    spark.range(60).selectExpr("id as l_orderkey", "CAST(id AS DOUBLE) as l_quantity").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(60).selectExpr("id as c_custkey", "'A' as c_mktsegment").write.parquet(f"{tmp_path}/customer.parquet")
    total = float(sum(range(60)))
    want = [("inner", "A", 60, total), ("left", "A", 60, total), ("left_semi", None, 60, total), ("left_anti", None, 0, None)]
    assert rows(relational.t4_split_join(spark, str(tmp_path))) == sorted(want, key=str)


def test_heavy_rows_are_dealt_to_several_tasks(spark):
    a = spark.range(4000).selectExpr("id as i", "IF(id % 2 = 0, 7L, id + 10) as k")
    b = spark.range(10).selectExpr("id as k", "id as v")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        tasks = lambda df: max(r["count"] for r in df.filter("k = 7").groupBy(F.spark_partition_id()).count().collect())
        assert tasks(a.join(b, "k")) == 2000
        assert tasks(joins.split_join(a, b, "k", hot_rows=100, parts=16)) < 1200
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


# --- windows -------------------------------------------------------------------------------


def test_sliding_equals_rows_in_each_window(spark):
    rng = random.Random(4)
    data = [(rng.choice([None, "a", "b"]), at(rng.choice([None, rng.randint(0, 300)])), rng.choice([None, 1e9 + rng.random()])) for _ in range(200)]
    df = spark.createDataFrame(data, "k string, t timestamp, v double")
    got = windows.sliding(df, "t", ("k",), "v", "60 minutes", "15 minutes")
    want = (
        df.groupBy(F.window("t", "60 minutes", "15 minutes"), "k")
        .agg(F.count("*").alias("n"), F.avg("v").alias("a"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.stddev("v").alias("s"))
        .select("window.start", "window.end", "k", "n", "a", "lo", "hi", "s")
    )
    near = lambda r: tuple(pytest.approx(x, rel=1e-9, abs=1e-6) if isinstance(x, float) else x for x in r)
    order = lambda r: str(r[:3])
    for g, w in zip(sorted(map(tuple, got.collect()), key=order), sorted(map(tuple, want.collect()), key=order), strict=True):
        assert g == near(w)
    assert rows(windows.sliding(df.limit(0), "t", ("k",), "v", "60 minutes", "15 minutes")) == []


def test_windows_repeat_panes_and_not_rows(spark):
    df = spark.range(10_000).selectExpr("timestamp_seconds(id % 600) as t", "CAST(id AS DOUBLE) as v")
    text = plan(windows.sliding(df, "t", (), "v", "10 minutes", "1 minute"))
    physical = text.split("== Physical Plan ==")[1]
    # the step that repeats stands above the first aggregate
    assert physical.index("Expand") < physical.rindex("HashAggregate")


def test_a_gap_of_just_the_threshold_goes_on(spark):
    data = [("u", at(0)), ("u", at(30)), ("u", at(61)), ("u", at(61)), (None, at(5)), ("v", None)]
    df = spark.createDataFrame(data, "u string, t timestamp")
    got = rows(windows.sessions(df, "t", ("u",), "30 minutes").select("u", "session_start", "session_end", "event_count"))
    assert got == sorted([("u", at(0), at(60), 2), ("u", at(61), at(91), 2), (None, at(5), at(35), 1)], key=str)
    assert rows(windows.sessions(df.limit(0), "t", ("u",), "30 minutes")) == []
    assert "MergingSessions" in plan(windows.sessions(df, "t", ("u",), "30 minutes")) or "UpdatingSessions" in plan(windows.sessions(df, "t", ("u",), "30 minutes"))


# --- state ---------------------------------------------------------------------------------

CLOSE = ("close", -1, 100_000)


def parts(spark, *batches, schema="kind string, i int, t timestamp"):
    return [spark.createDataFrame([(*r[:-1], at(r[-1])) for r in b], schema) for b in batches]


def test_stream_join_across_restarts(spark):
    first = [("a", 1, 0), ("a", 2, 10), ("a", None, 10), ("b", 1, 60), ("b", 1, 61)]
    second = [("b", 2, 70), ("b", 2, 70), ("b", None, 11), ("a", 3, 80), ("b", 3, 79)]
    close = [("a", -1, 100_000), ("b", -2, 100_000)]

    def join(stream):
        left = stream.filter("kind = 'a'").select("i", "t")
        right = stream.filter("kind = 'b'").select("i", F.col("t").alias("later"))
        return stateful.interval_join(left, right, ("i",), "t", "later", "60 minutes", "2 hours", how="left")

    out = stateful.replayed(spark, parts(spark, first, second, close), join).filter("i >= 0 or i is null")
    want = [(1, at(0), at(60)), (2, at(10), at(70)), (2, at(10), at(70)), (3, at(80), None), (None, at(10), None)]
    assert rows(out) == sorted(want, key=str)


def test_stream_join_is_symmetric_state(spark):
    from driftloom.sources.shared import shared_path

    path = shared_path(spark, "state")
    parts(spark, [("a", 1, 0), ("b", 1, 5)])[0].write.parquet(path)
    stream = spark.readStream.schema("kind string, i int, t timestamp").parquet(path)
    left, right = stream.filter("kind = 'a'").select("i", "t"), stream.filter("kind = 'b'").select("i", F.col("t").alias("later"))
    joined = stateful.interval_join(left, right, ("i",), "t", "later", "1 hour", "1 hour")
    with stateful.rocksdb_state(spark):
        query = joined.writeStream.format("noop").option("checkpointLocation", shared_path(spark, "log")).trigger(availableNow=True).start()
    query.awaitTermination()
    text = query._jsq.explainInternal(False)
    assert "StreamingSymmetricHashJoin" in text
    operators = query.lastProgress["stateOperators"]
    assert operators[0]["operatorName"] == "symmetricHashJoin" and operators[0]["customMetrics"].get("rocksdbCommitFlushLatency", 0) >= 0


def test_once_only_across_restarts(spark):
    first, second = [("x", 1, 0), ("x", 1, 0), ("y", 2, 5), (None, 3, 6)], [("x", 9, 0), ("z", 1, 50), (None, 4, 6), ("y", 2, 5)]
    out = stateful.replayed(spark, parts(spark, first, second), lambda s: stateful.once(s, ("kind",), "t", "1 hour"))
    assert Counter(r.kind for r in out.collect()) == {"x": 1, "y": 1, "z": 1, None: 1}


def test_silence_is_the_same_in_any_order(spark):
    """Rows of a key come late and out of order; the end of the time counts as inside."""
    seen = {1: [0, 30, 60, 61, 100], 2: [5], None: [7, 40]}
    flat = [("e", k, t) for k, ts in seen.items() for t in ts]
    random.Random(5).shuffle(flat)
    batches = [flat[:3], flat[3:6], flat[6:], [CLOSE]]
    out = stateful.replayed(spark, parts(spark, *batches), lambda s: stateful.silences(s, "i", "t", 30, "10 hours")).filter("i is null or i >= 0")
    want = [(k, at(t), at(t + 30)) for k, ts in seen.items() for t in ts if not any(t < x <= t + 30 for x in ts)]
    assert rows(out) == sorted(want, key=str)


def test_few_groups_have_a_store_for_each_core_at_most(spark):
    """Stores are loaded and committed in each micro-batch, however little is in them."""
    cores, shuffle = spark.sparkContext.defaultParallelism, "spark.sql.shuffle.partitions"
    before = spark.conf.get(shuffle)
    spark.conf.set(shuffle, 50)
    try:
        with stateful.rocksdb_state(spark, few_groups=True):
            assert int(spark.conf.get(shuffle)) == cores
        with stateful.rocksdb_state(spark):
            assert int(spark.conf.get(shuffle)) == 50
        assert int(spark.conf.get(shuffle)) == 50
    finally:
        spark.conf.set(shuffle, before)


def test_a_key_has_one_timer_for_all_its_silences():
    """Timers and calls to the state grow with keys, not with silences."""
    calls, kept = Counter(), [None]

    class State:
        def exists(self):
            return kept[0] is not None

        def get(self):
            return kept[0]

        def update(self, value):
            calls["update"] += 1
            kept[0] = value

        def clear(self):
            kept[0] = None

    class Handle:
        getValueState = lambda *_: State()
        registerTimer = lambda _, due: calls.update([due])

    due = lambda watermark, expiry: (type("W", (), {"getCurrentWatermarkInMs": lambda _: watermark})(), type("E", (), {"getExpiryTimeInMs": lambda _: expiry})())
    told = stateful._Silence(10)
    told.init(Handle())
    list(told.handleInputRows((1,), iter([Row(at=t) for t in range(0, 2000, 20)]), None))
    assert calls == {10: 1, "update": 1}
    got = list(told.handleExpiredTimer((1,), *due(1005, 10)))
    assert [(r.last, r.due) for r in got] == [(t, t + 10) for t in range(0, 995, 20)]
    assert kept[0][0] == list(range(1000, 2000, 20)) and calls[1010] == 1
    # a late one before the first of these, and one that follows it
    list(told.handleInputRows((1,), iter([Row(at=1006), Row(at=1990)]), None))
    got = list(told.handleExpiredTimer((1,), *due(10_000, 1010)))
    assert [r.last for r in got] == [t for t in range(1006, 2000) if (t % 20 == 0 and t != 1980) or t in (1006, 1990)]
    assert kept[0] is None and list(told.handleExpiredTimer((1,), *due(10_000, 1016))) == []


# --- groups and sets -----------------------------------------------------------------------


def test_grouping_sets(spark):
    data = [("a", 1, 1), ("a", 1, 1), ("a", None, 2), (None, 1, None), ("b", 2, 3)]
    df = spark.createDataFrame(data, "x string, y int, v int")
    want = defaultdict(lambda: [0, set()])
    for x, y, v in data:
        for bits in range(4):
            key = (None if bits & 2 else x, None if bits & 1 else y, bits)
            want[key][0] += 1
            want[key][1] |= {v} - {None}
    exact = grouping.exact_grouping_sets(df, ("x", "y"), "cube", "v")
    assert {(r.x, r.y, r.groups): (r.rows, r.distinct_values) for r in exact.collect()} == {k: (n, len(s)) for k, (n, s) in want.items()}
    about = grouping.grouping_sets(df, ("x", "y"), "cube", "v", "v")
    assert {(r.x, r.y, r.groups): (r.rows, r.distinct_about) for r in about.collect()} == {k: (n, len(s)) for k, (n, s) in want.items()}
    for f in (grouping.exact_grouping_sets, grouping.grouping_sets):
        assert rows(f(df.limit(0), ("x", "y"), "rollup", "v")) == []
    with pytest.raises(ValueError, match="cube"):
        grouping.grouping_sets(df, ("x",), "squares", "v")


def test_sketches_are_within_their_error(spark):
    df = spark.range(200_000).selectExpr("id % 4 as k", "id % 50000 as v")
    for r in grouping.grouping_sets(df, ("k",), "cube", "v").collect():
        exact = 50_000 if r.groups else 12_500
        assert abs(r.distinct_about - exact) <= 0.06 * exact


def test_one_scan_and_groups_expanded(spark):
    df = spark.range(1000).selectExpr("id % 4 as k", "id % 3 as l", "id as v")
    physical = plan(grouping.grouping_sets(df, ("k", "l"), "cube", "v")).split("== Physical Plan ==")[1]
    assert physical.count("Range (") == 1
    assert physical.index("Expand") < physical.rindex("Aggregate")


def test_top_by_key(spark):
    data = [("a", 5, i) for i in range(6)] + [("a", 9, 9), ("b", None, 1), (None, 3, 2)]
    df = spark.createDataFrame(data, "k string, v int, place int")
    got = grouping.top_by_key(df, ("k",), [F.desc("v")], 3)
    assert rows(got) == sorted([("a", 9, 9, 1), ("a", 5, 0, 2), ("a", 5, 1, 3), ("b", None, 1, 1), (None, 3, 2, 1)], key=str)
    tied = grouping.top_by_key(df, ("k",), [F.desc("v")], 3, ties=True)
    assert Counter(r.k for r in tied.collect()) == {"a": 7, "b": 1, None: 1}
    assert "WindowGroupLimit" in plan(got) and "WindowGroupLimit" in plan(tied)
    assert rows(grouping.top_by_key(df.limit(0), ("k",), [F.desc("v")], 3)) == []


def test_tasks_leave_k_rows_of_a_key(spark):
    """A key with nearly all rows brings k rows of each task to the exchange."""
    df = spark.range(0, 40_000, 1, 4).selectExpr("CAST(id < 0 AS INT) as k", "id as v")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        top = grouping.top_by_key(df, ("k",), [F.desc("v")], 5)
        before = plan(top).split("== Physical Plan ==")[1]
        assert before.count("WindowGroupLimit") == 2 and before.rindex("WindowGroupLimit") > before.index("Exchange")
        assert [r.v for r in top.orderBy("place").collect()] == [39_999, 39_998, 39_997, 39_996, 39_995]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_global_top(spark):
    df = spark.range(1000).selectExpr("id", "id % 10 as v")
    top = grouping.top(df, [F.desc("v")], 3)
    assert [r.id for r in top.collect()] == [9, 19, 29]
    assert "TakeOrderedAndProject" in plan(top)


def test_multisets(spark):
    rng = random.Random(6)
    row = lambda: (rng.choice([None, "", "a", "b"]), rng.choice([None, 1, 2]))
    left, right = [row() for _ in range(80)], [row() for _ in range(60)] + [("only", 1)]
    a, b = (spark.createDataFrame(x, "s string, n int") for x in (left, right))
    m, n = Counter(left), Counter(right)
    assert Counter(map(tuple, multisets.except_all(a, b).collect())) == m - n
    assert Counter(map(tuple, multisets.intersect_all(a, b).collect())) == m & n
    assert rows(multisets.except_all(a, b)) == rows(a.exceptAll(b))
    assert rows(multisets.intersect_all(a, b)) == rows(a.intersectAll(b))
    got = {(r.s, r.n): (r.sent, r.landed, r.state) for r in multisets.reconcile(a, b).collect()}
    assert {k: v[:2] for k, v in got.items()} == {k: (m[k], n[k]) for k in m | n}
    assert got["only", 1][2] == "foreign"
    assert rows(multisets.except_all(a.limit(0), b)) == []
    assert rows(multisets.except_all(a, b.limit(0))) == rows(a)
    with pytest.raises(ValueError, match="types"):
        multisets.reconcile(a, b.select("n", "s"))


def test_reconciling_neither_joins_nor_sorts_payloads(spark):
    a = spark.range(1000).selectExpr("CAST(id AS STRING) AS s")
    physical = plan(multisets.reconcile(a, a)).split("== Physical Plan ==")[1]
    assert "Join" not in physical and physical.count("Exchange") == 1
    for line in physical.splitlines():
        if " Sort [" in line:
            assert line.count("h1") and "c0" not in line.split("[")[1].split("]")[0]
