"""Queries on the order of a subject's readings: purchases as visits, other events as readings."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialspark.bindings.registry import query, rounded, sql_rounded, table
from trialspark.operators.glucose import VERY_LOW
from trialspark.operators.sequences import asof_join, episodes, time_weighted_range

# The sample readings lie hours apart, so a reading counts for a day.
MAX_GAP = timedelta(days=1)


def _visits_with_readings(spark: SparkSession, folder: str, **how: object) -> DataFrame:
    events = table(spark, folder, "events")
    visits = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    readings = events.where("event_type <> 'purchase'").select(
        "user_id", "ts", "value", F.col("event_id").alias("reading_id")
    )
    joined = asof_join(visits, readings, ["user_id"], "ts", "ts", **how)
    found = F.col("match")
    return joined.select(
        "event_id", "user_id", "ts", found["reading_id"].alias("reading_id"), found["value"].alias("glucose")
    )


def _sql_asof(comparison: str, condition: str = "TRUE") -> str:
    return f"""SELECT v.event_id, v.user_id, v.ts, CASE WHEN {condition} THEN r.event_id END AS reading_id,
        CASE WHEN {condition} THEN r.value END AS glucose
        FROM (SELECT * FROM events WHERE event_type = 'purchase') v
        ASOF LEFT JOIN (SELECT * FROM events WHERE event_type <> 'purchase') r
        ON v.user_id = r.user_id AND v.ts {comparison} r.ts"""


@query(_sql_asof(">="))
def asof_before(spark: SparkSession, folder: str) -> DataFrame:
    """Last reading up to each visit."""
    return _visits_with_readings(spark, folder)


@query(_sql_asof("<=", "r.ts - v.ts <= INTERVAL 6 HOUR"))
def asof_after(spark: SparkSession, folder: str) -> DataFrame:
    """First reading within six hours from each visit on."""
    return _visits_with_readings(spark, folder, forward=True, max_gap=timedelta(hours=6))


@query(
    """WITH readings AS (
        SELECT user_id, ts, value, value < 54 AS low,
            lag(ts) OVER w AS ts_before, lag(value) OVER w AS value_before
        FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL AND value IS NOT NULL
        WINDOW w AS (PARTITION BY user_id ORDER BY ts, value)),
    numbered AS (
        SELECT *, sum(CASE WHEN low AND value_before < 54 AND ts - ts_before <= INTERVAL 1 DAY THEN 0 ELSE 1 END)
            OVER (PARTITION BY user_id ORDER BY ts, value) AS run
        FROM readings)
    SELECT user_id, min(ts) AS start_time, max(ts) AS end_time, count(*) AS n_readings, min(value) AS least
    FROM numbered WHERE low GROUP BY user_id, run HAVING max(ts) - min(ts) >= INTERVAL 15 MINUTE"""
)
def low_episodes(spark: SparkSession, folder: str) -> DataFrame:
    """Episodes below 54 mg/dL of 15 minutes or more."""
    return episodes(table(spark, folder, "events"), ["user_id"], "ts", "value", VERY_LOW, max_gap=MAX_GAP)


def _sql_percent(condition: str) -> str:
    return sql_rounded(f"100.0 * coalesce(sum(weight) FILTER ({condition}), 0)::DOUBLE / nullif(sum(weight), 0)", 6)


@query(
    f"""WITH weighted AS (
        SELECT user_id, event_type, value, least(86400000000, coalesce(epoch_us(lead(ts) OVER w) - epoch_us(ts), 0)) AS weight
        FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL AND ts IS NOT NULL AND value IS NOT NULL
        WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, value))
    SELECT user_id, event_type, {sql_rounded("sum(weight) / 1e6", 6)} AS seconds,
        {_sql_percent("value < 70")} AS pct_time_below,
        {_sql_percent("value BETWEEN 70 AND 180")} AS pct_time_in_range,
        {_sql_percent("value > 180")} AS pct_time_above
    FROM weighted GROUP BY user_id, event_type"""
)
def weighted_range(spark: SparkSession, folder: str) -> DataFrame:
    """Time below, in and above range per subject and trial."""
    shares = time_weighted_range(
        table(spark, folder, "events"), ["user_id", "event_type"], "ts", "value", max_gap=MAX_GAP
    )
    return rounded(shares, 6, "seconds", "pct_time_below", "pct_time_in_range", "pct_time_above")
