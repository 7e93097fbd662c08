"""Daily range shares of readings that arrive late, kept up to date by a stream."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialspark.operators.glucose import HIGH, LOW
from trialspark.streaming.batch_log import BATCH, BatchLog

COUNTS = ("n_readings", "n_below", "n_in_range", "n_above")


@dataclass(frozen=True)
class Progress:
    """What one run of the stream took in."""

    n_rows: int
    n_too_late: int


def daily_range_counts(readings: DataFrame, by: Sequence[str], time: str, glucose: str) -> DataFrame:
    """``(day, *by, n_readings, n_below, n_in_range, n_above)`` of a table or a stream of readings.

    Days are those of UTC. Rows without a time or a value do not count; null groups do.
    """
    value = F.col(glucose)
    return (
        readings.where(value.isNotNull() & F.col(time).isNotNull())
        .groupBy(F.window(time, "1 day").alias("_day"), *by)
        .agg(
            F.count(F.lit(1)).alias("n_readings"),
            F.count_if(value < LOW).alias("n_below"),
            F.count_if(value.between(LOW, HIGH)).alias("n_in_range"),
            F.count_if(value > HIGH).alias("n_above"),
        )
        .select(F.to_date("_day.start").alias("day"), *by, *COUNTS)
    )


def update_daily_range(
    arriving: DataFrame, log: BatchLog, by: Sequence[str], time: str, glucose: str, delay: str
) -> Progress:
    """Take in the readings that have arrived since the last run.

    ``arriving`` is a stream. Spark's state store holds the counts of a group's day until
    the newest reading is ``delay`` (such as ``2 days``) past its end; each batch appends
    the days it changed to ``log``. A reading older than that can no longer change its
    day and is only counted, in ``n_too_late``, so ``delay`` has to cover how late readings come.
    """
    counts = daily_range_counts(arriving.withWatermark(time, delay), by, time, glucose)
    done = log.fill(counts, "update")
    progress = done.recentProgress
    late = sum(state["numRowsDroppedByWatermark"] for step in progress for state in step["stateOperators"])
    return Progress(sum(step["numInputRows"] for step in progress), late)


def current_daily_range(log: BatchLog, by: Sequence[str]) -> DataFrame:
    """The latest counts of each group and day, with the percent of readings in each range."""
    rows = log.read()
    counts = F.struct(*COUNTS)
    latest = rows.groupBy("day", *by).agg(F.max_by(counts, F.col(BATCH)).alias("_counts"))
    percents = [
        (100.0 * F.col(f"_counts.{name}") / F.col("_counts.n_readings")).alias(name.replace("n_", "pct_", 1))
        for name in COUNTS[1:]
    ]
    return latest.select("day", *by, F.col("_counts.n_readings").alias("n_readings"), *percents)
