"""Queries: pairing by time, brackets, days since an event, seasons."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.operators import temporal
from orrery.plans.statistics import read

QUERIES, ORACLES = {}, {}
VEGETATION, BARE_SOIL = (5, 6, 7, 8), (4, 9, 10)


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def daily(spark, sf_dir, kind):
    rows = read(spark, sf_dir, "events").where(F.col("event_type") == kind)
    return rows.select("user_id", F.to_date("ts").alias("obs_date"), F.col("value").alias("v"), F.col("event_id").alias("layer"))


@query(
    "WITH a AS (SELECT user_id, ts::DATE AS d, arg_min(value, event_id) AS v FROM events WHERE event_type = 'view' GROUP BY ALL), "
    "b AS (SELECT user_id, ts::DATE AS d, arg_min(value, event_id) AS v FROM events WHERE event_type = 'click' GROUP BY ALL) "
    "SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.d, b.d)::VARCHAR AS obs_date, round(a.v / (b.v + 1e-9), 6) AS ratio, "
    "CASE WHEN a.d IS NULL THEN 'missing_sentinel1_VV_for_ratio_' || b.d WHEN b.d IS NULL THEN 'missing_sentinel1_VH_for_ratio_' || a.d END AS flag "
    "FROM a FULL JOIN b ON a.user_id = b.user_id AND a.d = b.d"
)
def vv_vh_ratio(spark, sf_dir):
    got = temporal.paired_ratio(daily(spark, sf_dir, "view"), daily(spark, sf_dir, "click"), ["user_id"], "obs_date", "v", "layer")
    return got.select("user_id", F.col("obs_date").cast("string").alias("obs_date"), F.round("ratio", 6).alias("ratio"), "flag")


@query(
    "SELECT user_id, event_type, round(arg_max(value, row(ts::DATE, event_id)) - arg_min(value, row(ts::DATE, event_id)), 6) AS difference FROM events GROUP BY ALL HAVING count(DISTINCT event_id) >= 2"
)
def temporal_difference(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("user_id", "event_type", F.to_date("ts").alias("obs_date"), F.col("event_id").alias("layer"), "value")
    got = temporal.first_to_last(rows, ["user_id", "event_type"], "obs_date", "layer", "value")
    return got.select("user_id", "event_type", F.round("difference", 6).alias("difference"))


def _bracket_sql(early: str) -> str:
    return (
        "WITH e AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'error' AND value >= 1), o AS (SELECT user_id, ts, event_id, value FROM events WHERE event_type = 'view'), "
        f"b AS (SELECT e.event_id, arg_max(o.value, row(o.ts, o.event_id)) AS v FROM e JOIN o ON o.user_id = e.user_id AND o.ts {early} e.ts GROUP BY ALL), "
        "a AS (SELECT e.event_id, arg_min(o.value, row(o.ts, o.event_id)) AS v FROM e JOIN o ON o.user_id = e.user_id AND o.ts > e.ts GROUP BY ALL) "
        "SELECT e.event_id, e.user_id, round(b.v, 6) AS before_value, round(a.v, 6) AS after_value, {0} AS delta FROM e JOIN b ON b.event_id = e.event_id JOIN a ON a.event_id = e.event_id"
    )


def _sides(spark, sf_dir):
    rows = read(spark, sf_dir, "events")
    obs = rows.where("event_type = 'view'").select("user_id", "ts", "event_id", "value")
    events = rows.where("event_type = 'error' and value >= 1").select("user_id", "ts", F.col("event_id").alias("rain_id"))
    return obs, events


@query(_bracket_sql("<").format("round(b.v - a.v, 6)"))
def asof_bracket_strict(spark, sf_dir):
    """Post-rain drying: the last observation before an event less the first after it."""
    obs, events = _sides(spark, sf_dir)
    got = temporal.bracket(obs, events, ["user_id"], "ts", ["event_id"], ["value"], "rain_id").where("before is not null and after is not null")
    delta = temporal.drying_delta(F.lit("NDMI"), F.col("before.value"), F.col("after.value"))
    return got.select(F.col("rain_id").alias("event_id"), "user_id", F.round("before.value", 6).alias("before_value"), F.round("after.value", 6).alias("after_value"), F.round(delta, 6).alias("delta"))


@query(_bracket_sql("<=").format("round(abs(a.v - b.v), 6)"))
def asof_bracket_inclusive(spark, sf_dir):
    """Event response: the change from the last observation up to an event to the first after it."""
    obs, events = _sides(spark, sf_dir)
    got = temporal.bracket(obs, events, ["user_id"], "ts", ["event_id"], ["value"], "rain_id", inclusive_before=True).where("before is not null and after is not null")
    delta = temporal.event_response(F.col("before.value"), F.col("after.value"))
    return got.select(F.col("rain_id").alias("event_id"), "user_id", F.round("before.value", 6).alias("before_value"), F.round("after.value", 6).alias("after_value"), F.round(delta, 6).alias("delta"))


@query(
    "WITH e AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'error' AND value >= 1), o AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'view') "
    "SELECT o.event_id, max(row(e.ts, e.event_id))[2] AS last_event, date_diff('day', (max(row(e.ts, e.event_id))[1])::DATE, o.ts::DATE)::INT AS days_since "
    "FROM o LEFT JOIN e ON e.user_id = o.user_id AND e.ts::DATE <= o.ts::DATE GROUP BY o.event_id, o.ts"
)
def days_since_event(spark, sf_dir):
    rows = read(spark, sf_dir, "events")
    obs = rows.where("event_type = 'view'").select("event_id", "user_id", "ts")
    events = rows.where("event_type = 'error' and value >= 1").select("user_id", "ts", "event_id")
    return temporal.days_since(obs, events, ["user_id"], "ts", "event_id").select("event_id", "last_event", "days_since")


_NAME = "CASE o_orderpriority WHEN '1-URGENT' THEN 'NDVI' WHEN '2-HIGH' THEN 'BSI' WHEN '3-MEDIUM' THEN 'LST' ELSE 'NDRE' END"


@query(
    f"SELECT o_orderkey, {_NAME} AS name FROM orders WHERE CASE {_NAME} WHEN 'NDVI' THEN month(o_orderdate) IN {VEGETATION} WHEN 'NDRE' THEN month(o_orderdate) IN {VEGETATION} WHEN 'BSI' THEN month(o_orderdate) IN {BARE_SOIL} ELSE true END"
)
def month_window_filter(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select("o_orderkey", F.expr(_NAME).alias("name"), F.to_date("o_orderdate").alias("obs_date"))
    return temporal.season_filter(rows, "name", "obs_date", VEGETATION, BARE_SOIL)[0].select("o_orderkey", "name")


@query(
    f"SELECT DISTINCT 'skipped_out_of_window_' || {_NAME} || '_' || o_orderdate::DATE AS flag FROM orders WHERE NOT CASE {_NAME} WHEN 'NDVI' THEN month(o_orderdate) IN {VEGETATION} WHEN 'NDRE' THEN month(o_orderdate) IN {VEGETATION} WHEN 'BSI' THEN month(o_orderdate) IN {BARE_SOIL} ELSE true END"
)
def month_window_flags(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select("o_orderkey", F.expr(_NAME).alias("name"), F.to_date("o_orderdate").alias("obs_date"))
    return temporal.season_filter(rows, "name", "obs_date", VEGETATION, BARE_SOIL)[1]


@query(
    "WITH e AS (SELECT event_id, ts::DATE::VARCHAR AS event_date, CASE WHEN value >= 20 THEN round(value, 2) END AS mm FROM events WHERE event_type = 'error') "
    "SELECT event_id::VARCHAR AS context_id, event_date, 'rain_event' AS name, 1.0::DOUBLE AS value, NULL AS flag FROM e UNION ALL "
    "SELECT event_id::VARCHAR, event_date, 'rainfall_mm', mm, CASE WHEN mm IS NULL THEN 'missing_rainfall_mm_' || event_date END FROM e"
)
def rain_scalars(spark, sf_dir):
    rows = read(spark, sf_dir, "events").where("event_type = 'error'")
    events = rows.select(F.col("event_id").cast("string").alias("context_id"), F.to_date("ts").cast("string").alias("event_date"), F.when(F.col("value") >= 20, F.round("value", 2)).alias("rainfall_mm"))
    return temporal.rain_scalars(events)


@query(
    "SELECT event_id, user_id, obs_date, event_type, v FROM (SELECT event_id, user_id, ts::DATE::VARCHAR AS obs_date, event_type, round(value, 6) AS v, row_number() OVER (PARTITION BY user_id, event_type, ts::DATE ORDER BY event_id) AS n FROM events) WHERE n = 1"
)
def first_layer_of_date(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("event_id", "user_id", F.to_date("ts").cast("string").alias("obs_date"), "event_type", F.round("value", 6).alias("v"))
    return temporal.first_of_date(rows, ["user_id", "event_type"], "obs_date", "event_id")
