"""Queries whose results a stream builds up over several runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialspark.bindings.registry import query, rounded, sql_rounded, table
from trialspark.session import new_workspace
from trialspark.streaming.batch_log import BatchLog
from trialspark.streaming.late_readings import current_daily_range, update_daily_range
from trialspark.streaming.loads import load_new_files

# Readings arrive up to this many hours after they were taken.
LATEST_HOURS = 36
DELIVERIES = 3


@query(
    f"""SELECT ts::DATE AS day, user_id, count(*) AS n_readings,
        {sql_rounded("100.0 * count(*) FILTER (value < 70) / count(*)", 6)} AS pct_below,
        {sql_rounded("100.0 * count(*) FILTER (value BETWEEN 70 AND 180) / count(*)", 6)} AS pct_in_range,
        {sql_rounded("100.0 * count(*) FILTER (value > 180) / count(*)", 6)} AS pct_above
    FROM events WHERE ts IS NOT NULL AND value IS NOT NULL GROUP BY ALL"""
)
def late_daily_range(spark: SparkSession, folder: str) -> DataFrame:
    """Daily range shares kept up to date while readings arrive late, in several deliveries."""
    work = new_workspace(spark, "late")
    events = table(spark, folder, "events")
    readings = events.select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value", "event_id")
    lateness = F.make_dt_interval(hours=F.pmod(F.xxhash64("event_id"), F.lit(LATEST_HOURS)).cast("int"))
    arrived = readings.where("ts IS NOT NULL").withColumn("arrival", F.col("ts") + lateness)
    ends = arrived.agg(F.min("arrival").alias("first"), F.max("arrival").alias("last")).first()
    span = (ends["last"] - ends["first"]) / DELIVERIES if ends["first"] else None
    # Delivery k holds what has arrived since the end of delivery k - 1; no readings make one empty delivery.
    cuts = [ends["first"] + number * span for number in range(1, DELIVERIES)] if span else []
    log = BatchLog(spark, f"{work}/log")
    for start, stop in zip([None, *cuts], [*cuts, None]):
        rows = arrived if start is None else arrived.where(F.col("arrival") >= start)
        rows = rows if stop is None else rows.where(F.col("arrival") < stop)
        rows.write.mode("append").parquet(f"{work}/in")
        stream = spark.readStream.schema(arrived.schema).parquet(f"{work}/in")
        update_daily_range(stream, log, ["user_id"], "ts", "value", f"{LATEST_HOURS} hours")
    return rounded(current_daily_range(log, ["user_id"]), 6, "pct_below", "pct_in_range", "pct_above")


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders")
def incremental_load(spark: SparkSession, folder: str) -> DataFrame:
    """Orders exported file by file into one folder, loaded by runs that each add what is new."""
    work = new_workspace(spark, "increments")
    orders = table(spark, folder, "orders")
    loaded = None
    for number in range(DELIVERIES):
        part = orders.where(F.pmod("o_orderkey", F.lit(DELIVERIES)) == number)
        form = {"header": "true", "sep": "|", "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss[.SSSSSS]"}
        part.write.mode("append").options(**form).csv(f"{work}/in")
        loaded = load_new_files(spark, f"{work}/in", f"{work}/table")
    return loaded.select(
        "o_orderkey",
        "o_custkey",
        "o_orderstatus",
        "o_totalprice",
        F.col("o_orderdate").cast("timestamp_ntz").alias("o_orderdate"),
        "o_orderpriority",
    )
