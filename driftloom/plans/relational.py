"""Queries of joins, windows, state and sets over the test tables, each with the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.operators import grouping, joins, multisets, windows
from driftloom.plans.catalog import query
from driftloom.sources.tables import table
from driftloom.streaming import stateful

#: Rows of a key from which the queries cut it; so that the test tables have such keys.
_HOT = 200


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value")


def _time(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(column)


def _sql_time(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S.%f') AS {column}"


def _parts(events: DataFrame, time: str = "ts") -> list[DataFrame]:
    """Events in two parts by time, and a row a day later that lets the watermark pass them all.

    Its ids are -1 and its type is 'closing'.
    """
    first, last = (F.unix_micros(f(time)) for f in (F.min, F.max))
    bounds = events.select(((first + last) / 2).cast("long").alias("middle"), (last + 86_400_000_000).alias("close"))
    middle, close = bounds.first() or (0, 0)
    if middle is None:
        return [events]
    closing = events.sparkSession.range(1).select(
        F.lit(-1).cast("long").alias("event_id"), F.timestamp_micros(F.lit(close)).alias(time), F.lit(-1).cast("long").alias("user_id"),
        F.lit("closing").alias("event_type"), F.lit(0.0).alias("value"),
    )
    before = F.unix_micros(time) <= middle
    return [events.filter(before), events.filter(~before), closing]


@query(
    "t1_stream_interval_join",
    """SELECT v.event_id AS view_id, p.event_id AS purchase_id, v.user_id, p.value AS spent
    FROM (SELECT * FROM events WHERE event_type = 'view') v LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p
    ON p.user_id = v.user_id AND p.ts >= v.ts AND p.ts <= v.ts + INTERVAL 1 HOUR""",
)
def t1_stream_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views with the purchases of their user within an hour, as two streams with state."""

    def joined(stream: DataFrame) -> DataFrame:
        kind = lambda k: stream.filter(F.col("event_type").isin(k, "closing"))
        views = kind("view").select(F.col("event_id").alias("view_id"), "user_id", "ts")
        bought = kind("purchase").select(F.col("event_id").alias("purchase_id"), "user_id", F.col("ts").alias("bought_at"), F.col("value").alias("spent"))
        return stateful.interval_join(views, bought, ("user_id",), "ts", "bought_at", "1 hour", "10 minutes", how="left")

    out = stateful.replayed(spark, _parts(_events(spark, sf_dir)), joined)
    return out.filter("view_id >= 0").select("view_id", "purchase_id", "user_id", "spent")


@query(
    "t2_asof_join",
    """SELECT p.event_id, p.user_id, c.event_id AS click_id, c.value AS click_value
    FROM (SELECT * FROM events WHERE event_type = 'purchase') p
    ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') c ON p.user_id = c.user_id AND p.ts >= c.ts""",
)
def t2_asof_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase with its user's last click."""
    e = _events(spark, sf_dir)
    clicks = e.filter("event_type = 'click'").select("user_id", F.col("ts").alias("clicked_at"), F.col("event_id").alias("click_id"), F.col("value").alias("click_value"))
    bought = e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    out = joins.asof(bought, clicks, ("user_id",), "ts", "clicked_at", ("click_id", "click_value"))
    return out.select("event_id", "user_id", "click_id", "click_value")


@query(
    "t2_asof_join_hot_key",
    """SELECT p.event_id, p.kind, c.event_id AS click_id FROM
    (SELECT *, CASE WHEN event_id % 3 = 0 THEN -1 ELSE user_id END AS kind FROM events WHERE event_type <> 'click') p
    ASOF LEFT JOIN (SELECT *, CASE WHEN event_id % 3 = 0 THEN -1 ELSE user_id END AS kind FROM events WHERE event_type = 'click') c
    ON p.kind = c.kind AND p.ts >= c.ts""",
)
def t2_asof_join_hot_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a key that has a third of all rows, cut into ranges of time."""
    e = _events(spark, sf_dir).withColumn("kind", F.when(F.col("event_id") % 3 == 0, F.lit(-1)).otherwise(F.col("user_id")).cast("long"))
    clicks = e.filter("event_type = 'click'").select("kind", F.col("ts").alias("clicked_at"), F.col("event_id").alias("click_id"))
    rest = e.filter("event_type <> 'click'").select("event_id", "kind", "ts")
    out = joins.asof(rest, clicks, ("kind",), "ts", "clicked_at", ("click_id",), hot_rows=_HOT)
    return out.select("event_id", "kind", "click_id")


@query(
    "t3_interval_bins",
    """SELECT e.event_id AS error_id, count(p.event_id) AS purchases, round(coalesce(sum(p.value), 0), 4) AS spent
    FROM (SELECT * FROM events WHERE event_type = 'error') e LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p
    ON p.ts >= e.ts AND p.ts < e.ts + INTERVAL 1 MINUTE * (CASE WHEN e.event_id % 97 = 0 THEN 20000 ELSE e.event_id % 60 + 1 END)
    GROUP BY 1""",
)
def t3_interval_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases while an error lasts, which is minutes for most and two weeks for some."""
    e = _events(spark, sf_dir).withColumn("at", F.unix_micros("ts"))
    lasts = F.when(F.col("event_id") % 97 == 0, 20_000).otherwise(F.col("event_id") % 60 + 1) * 60_000_000
    errors = e.filter("event_type = 'error'").select(F.col("event_id").alias("error_id"), F.col("at").alias("since"), (F.col("at") + lasts).alias("until"))
    bought = e.filter("event_type = 'purchase'").select("event_id", "value", "at").withColumn("exact", F.expr("try_cast(value AS DECIMAL(30, 14))"))
    sums = {"purchases": F.col("event_id").isNotNull().cast("long"), "spent": F.col("exact")}
    met = joins.interval_totals(bought, errors, "at", "since", "until", sums).groupBy("error_id").agg(F.sum("purchases").alias("purchases"), F.sum("spent").cast("double").alias("spent"))
    # values beyond decimals, as NaN, are added by their pairs
    odd = bought.filter("value IS NOT NULL AND exact IS NULL")
    if not odd.isEmpty():
        beyond = joins.within_intervals(odd, errors, "at", "since", "until").groupBy("error_id").agg(F.sum("value").alias("beyond"))
        met = met.join(beyond, "error_id", "left").withColumn("spent", F.coalesce("spent", F.lit(0.0)) + F.coalesce("beyond", F.lit(0.0)))
    return met.select("error_id", "purchases", F.round(F.coalesce("spent", F.lit(0.0)), 4).alias("spent"))


_KEYED = "(SELECT *, CASE WHEN l_orderkey % 3 = 0 THEN 7 ELSE l_orderkey % 40000 END AS k FROM lineitem)"


@query(
    "t4_split_join",
    f"""SELECT 'inner' AS how, c_mktsegment AS segment, count(*) AS rows, round(sum(l_quantity), 2) AS quantity
      FROM {_KEYED} JOIN customer ON k = c_custkey GROUP BY 2
    UNION ALL SELECT 'left', c_mktsegment, count(*), round(sum(l_quantity), 2) FROM {_KEYED} LEFT JOIN customer ON k = c_custkey GROUP BY 2
    UNION ALL SELECT 'left_semi', NULL, count(*), round(sum(l_quantity), 2) FROM {_KEYED} WHERE k IN (SELECT c_custkey FROM customer)
    UNION ALL SELECT 'left_anti', NULL, count(*), round(sum(l_quantity), 2) FROM {_KEYED} WHERE k NOT IN (SELECT c_custkey FROM customer)""",
)
def t4_split_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by a key that a third of them share, with customers: inner, left, semi and anti."""
    lines = table(spark, sf_dir, "lineitem").withColumn("k", F.when(F.col("l_orderkey") % 3 == 0, F.lit(7)).otherwise(F.col("l_orderkey") % 40000).cast("long"))
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), "c_mktsegment")
    out = None
    for how in ("inner", "left", "left_semi", "left_anti"):
        met = joins.split_join(lines, customers, "k", how, hot_rows=_HOT, parts=8)
        totals = F.count("*").alias("rows"), F.round(F.sum("l_quantity"), 2).alias("quantity")
        if "c_mktsegment" in met.columns:
            found = met.groupBy(F.col("c_mktsegment").alias("segment")).agg(*totals)
        else:
            # one row, also where no line is left
            found = met.agg(*totals).withColumn("segment", F.lit(None).cast("string"))
        found = found.select(F.lit(how).alias("how"), "segment", "rows", "quantity")
        out = found if out is None else out.unionByName(found)
    return out


_SESSIONS = f"""WITH m AS (SELECT *, CASE WHEN ts > lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS no FROM m),
  g AS (SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS event_count, round(sum(value), 4) AS sum_value
    FROM s GROUP BY user_id, no)
SELECT user_id, {_sql_time("session_start")}, {_sql_time("session_end")}, event_count, sum_value FROM g"""


def _shown_sessions(out: DataFrame) -> DataFrame:
    return out.select("user_id", _time("session_start"), _time("session_end"), "event_count", F.round("sum_value", 4).alias("sum_value"))


@query("t5_sessions", _SESSIONS)
def t5_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown_sessions(windows.sessions(_events(spark, sf_dir), "ts", ("user_id",), "30 minutes", "value"))


@query("t5_stream_sessions", _SESSIONS)
def t5_stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a stream with merging state; a session comes out when it has ended."""
    sessions = lambda stream: windows.sessions(stream, "ts", ("user_id",), "30 minutes", "value", watermark="10 minutes")
    return _shown_sessions(stateful.replayed(spark, _parts(_events(spark, sf_dir)), sessions).filter("user_id >= 0"))


_SLIDING = f"""WITH w AS (SELECT *, unnest(range(0, 24)) AS k FROM events),
  x AS (SELECT time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') - INTERVAL 1 HOUR * k AS window_start, event_type, value FROM w),
  g AS (SELECT window_start, event_type, count(*) AS event_count, round(avg(value), 9) AS avg_value, min(value) AS min_value, max(value) AS max_value,
    round(stddev_samp(value), 9) AS stddev_value FROM x GROUP BY ALL)
SELECT {_sql_time("window_start")}, event_type, event_count, avg_value, min_value, max_value, stddev_value FROM g"""


def _shown_windows(out: DataFrame) -> DataFrame:
    # at fewer digits averages of a few rows lie just between two rounded values
    rounded = (F.round(c, 9).alias(c) for c in ("avg_value", "stddev_value"))
    return out.select(_time("window_start"), "event_type", "event_count", "min_value", "max_value", *rounded)


@query("t6_sliding_panes", _SLIDING)
def t6_sliding_panes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of a day that begin every hour, from panes of an hour."""
    return _shown_windows(windows.sliding(_events(spark, sf_dir), "ts", ("event_type",), "value", "24 hours", "1 hour"))


@query("t6_stream_sliding_panes", _SLIDING)
def t6_stream_sliding_panes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a stream: two stateful steps, panes and then windows."""
    panes = lambda stream: windows.sliding(stream, "ts", ("event_type",), "value", "24 hours", "1 hour", watermark="10 minutes")
    parts = _parts(_events(spark, sf_dir))
    # windows end up to a day after the last event, so the closing row comes two days later
    later = [p if k < 2 else p.withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 DAY")) for k, p in enumerate(parts)]
    return _shown_windows(stateful.replayed(spark, later, panes, few_groups=True).filter("event_type <> 'closing'"))


@query(
    "t7_silent_users",
    f"""WITH n AS (SELECT user_id, ts AS last_seen, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS next FROM
      (SELECT DISTINCT user_id, date_trunc('millisecond', ts) AS ts FROM events)),
    s AS (SELECT user_id, last_seen, last_seen + INTERVAL 720 MINUTE AS silent_at FROM n WHERE next IS NULL OR next > last_seen + INTERVAL 720 MINUTE)
    SELECT user_id, {_sql_time("last_seen")}, {_sql_time("silent_at")} FROM s""",
)
def t7_silent_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users who haven't been heard of for twelve hours, by timers of event time."""
    told = lambda stream: stateful.silences(stream, "user_id", "ts", 720, "10 minutes")
    out = stateful.replayed(spark, _parts(_events(spark, sf_dir)), told).filter("user_id >= 0")
    return out.select("user_id", _time("last_seen"), _time("silent_at"))


@query("t8_once_only", f"SELECT event_id, {_sql_time('ts')}, event_type FROM events")
def t8_once_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of which every third is sent three times, over two parts of a stream, land once."""
    first, second, *rest = _parts(_events(spark, sf_dir))
    again = lambda df: df.filter("event_id % 3 = 0")
    parts = [first.unionByName(again(first)), again(first).unionByName(second).unionByName(again(second)).unionByName(again(second)), *rest]
    landed = stateful.replayed(spark, parts, lambda stream: stateful.once(stream, ("event_id",), "ts", "1 hour"))
    return landed.filter("event_id >= 0").select("event_id", _time("ts"), "event_type")


_CUBE = """SELECT event_type, hour::INTEGER AS hour, grouping(event_type, hour)::BIGINT AS groups, count(*) AS rows, count(DISTINCT user_id) AS users
    FROM (SELECT *, hour(ts) AS hour FROM events) GROUP BY {}"""


def _hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).withColumn("hour", F.hour("ts"))


@query("t9_cube_distinct", _CUBE.format("CUBE (event_type, hour)"))
def t9_cube_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and users by type and hour, each, both and neither."""
    out = grouping.exact_grouping_sets(_hours(spark, sf_dir), ("event_type", "hour"), "cube", "user_id")
    return out.withColumnRenamed("distinct_values", "users")


@query("t9_grouping_sets_distinct", _CUBE.format("GROUPING SETS ((event_type), (hour), ())"))
def t9_grouping_sets_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = grouping.exact_grouping_sets(_hours(spark, sf_dir), ("event_type", "hour"), [("event_type",), ("hour",), ()], "user_id")
    return out.withColumnRenamed("distinct_values", "users")


@query(
    "t9_rollup_sketches",
    f"""SELECT event_type, hour, groups, rows, round(total, 4) AS sum_value, users AS at_least, TRUE AS close FROM
    (SELECT event_type, hour::INTEGER AS hour, grouping(event_type, hour)::BIGINT AS groups, count(*) AS rows, sum(value) AS total,
      count(DISTINCT user_id) AS users FROM (SELECT *, hour(ts) AS hour FROM events) GROUP BY ROLLUP (event_type, hour))""",
)
def t9_rollup_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, sums and users of a rollup from one scan, users by united sketches; beside them exact numbers, and whether the sketches are within 6 % or 2."""
    e = _hours(spark, sf_dir)
    about = grouping.grouping_sets(e, ("event_type", "hour"), "rollup", "user_id", "value")
    exact = grouping.exact_grouping_sets(e, ("event_type", "hour"), "rollup", "user_id").select(
        F.col("event_type").alias("t"), F.col("hour").alias("h"), F.col("groups").alias("g"), F.col("distinct_values").alias("at_least")
    )
    same = F.col("event_type").eqNullSafe(F.col("t")) & F.col("hour").eqNullSafe(F.col("h")) & (F.col("groups") == F.col("g"))
    close = F.abs(F.col("distinct_about") - F.col("at_least")) <= F.greatest(0.06 * F.col("at_least"), F.lit(2.0))
    return about.join(exact, same).select("event_type", "hour", "groups", "rows", F.round("sum_value", 4).alias("sum_value"), "at_least", close.alias("close"))


@query(
    "t10_top_by_key",
    """SELECT event_type, event_id, value, place FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id)::INTEGER AS place FROM events)
    WHERE place <= 10""",
)
def t10_top_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten largest values of each type."""
    e = _events(spark, sf_dir).select("event_id", "event_type", "value")
    return grouping.top_by_key(e, ("event_type",), [F.desc("value")], 10)


@query(
    "t10_top_with_ties",
    """SELECT o_orderstatus, o_orderkey, o_orderdate::DATE::VARCHAR AS day, place FROM
    (SELECT *, rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate)::INTEGER AS place FROM orders) WHERE place <= 3""",
)
def t10_top_with_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three earliest orders of each status, and all of the same days."""
    out = grouping.top_by_key(table(spark, sf_dir, "orders"), ("o_orderstatus",), [F.col("o_orderdate")], 3, ties=True)
    return out.select("o_orderstatus", "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "place")


@query("t10_top", "SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 100")
def t10_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.top(_events(spark, sf_dir).select("event_id", "value"), [F.desc("value")], 100)


_SENT = "SELECT event_type, user_id FROM events"
_LANDED = """(SELECT event_type, user_id FROM events WHERE event_id % 7 <> 0 UNION ALL SELECT event_type, user_id FROM events WHERE event_id % 5 = 0
    UNION ALL SELECT 'foreign', user_id FROM events WHERE event_id % 50 = 0)"""


def _both_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Events as they were sent, and as they landed: some lost, some twice, some of others."""
    e = _events(spark, sf_dir)
    pick = lambda rows: rows.select("event_type", "user_id")
    foreign = e.filter("event_id % 50 = 0").select(F.lit("foreign").alias("event_type"), "user_id")
    return pick(e), pick(e.filter("event_id % 7 <> 0")).union(pick(e.filter("event_id % 5 = 0"))).union(foreign)


@query(
    "t11_reconcile",
    f"""WITH s AS (SELECT event_type, user_id, count(*) AS n FROM ({_SENT}) GROUP BY ALL), l AS (SELECT event_type, user_id, count(*) AS n FROM {_LANDED} GROUP BY ALL),
    b AS (SELECT event_type, user_id, coalesce(s.n, 0) AS sent, coalesce(l.n, 0) AS landed FROM s FULL JOIN l USING (event_type, user_id))
    SELECT *, CASE WHEN sent = landed THEN 'ok' WHEN sent = 0 THEN 'foreign' WHEN landed < sent THEN 'lost' ELSE 'repeated' END AS state FROM b""",
)
def t11_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multisets.reconcile(*_both_sides(spark, sf_dir))


@query("t11_except_all", f"{_SENT} EXCEPT ALL SELECT * FROM {_LANDED}")
def t11_except_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multisets.except_all(*_both_sides(spark, sf_dir))


@query("t11_intersect_all", f"{_SENT} INTERSECT ALL SELECT * FROM {_LANDED}")
def t11_intersect_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multisets.intersect_all(*_both_sides(spark, sf_dir))
