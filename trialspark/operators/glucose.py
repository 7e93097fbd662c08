"""Glucose metrics per group over a table of readings in mg/dL.

Every metric is a combinable aggregate, so all of them cost one pass and one
small shuffle together, however unevenly subjects are filled. Missing readings
do not count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialspark.functions.numeric import percent_where

# Consensus thresholds in mg/dL.
VERY_LOW, LOW, HIGH, VERY_HIGH = 54, 70, 180, 250

# Glucose Management Indicator (Bergenstal et al. 2018),
# GMI = 3.31 + 0.02392 * mean glucose in mg/dL.
GMI_BASE, GMI_SLOPE = 3.31, 0.02392


def below_range(glucose: str) -> list[Column]:
    """Percent of readings below 70 and below 54."""
    value = F.col(glucose)
    return [
        percent_where(value < LOW, glucose).alias("pct_below_70"),
        percent_where(value < VERY_LOW, glucose).alias("pct_below_54"),
    ]


def above_range(glucose: str) -> list[Column]:
    """Percent of readings above 180 and above 250."""
    value = F.col(glucose)
    return [
        percent_where(value > HIGH, glucose).alias("pct_above_180"),
        percent_where(value > VERY_HIGH, glucose).alias("pct_above_250"),
    ]


def in_range(glucose: str) -> list[Column]:
    """Percent of readings from 70 to 180, both included."""
    return [percent_where(F.col(glucose).between(LOW, HIGH), glucose).alias("pct_in_range")]


def variability(glucose: str) -> list[Column]:
    """Sample standard deviation, and coefficient of variation in percent."""
    deviation = F.stddev_samp(glucose)
    mean = F.avg(glucose)
    return [
        deviation.alias("sd"),
        F.when(mean != 0, 100.0 * deviation / mean).alias("cv"),
    ]


def mean_and_gmi(glucose: str) -> list[Column]:
    """Mean glucose and the Glucose Management Indicator."""
    mean = F.avg(glucose)
    return [
        mean.alias("mean_glucose"),
        (F.lit(GMI_BASE) + F.lit(GMI_SLOPE) * mean).alias("gmi"),
    ]


def glucose_metrics(
    readings: DataFrame, by: Sequence[str], glucose: str, *metrics: list[Column]
) -> DataFrame:
    """Number of readings and the given metrics per group, e.g. ``in_range("glucose")``.

    Without metrics all of them are computed.
    """
    chosen = metrics or (
        below_range(glucose),
        in_range(glucose),
        above_range(glucose),
        mean_and_gmi(glucose),
        variability(glucose),
    )
    columns = [column for metric in chosen for column in metric]
    return readings.groupBy(*by).agg(F.count(glucose).alias("n_readings"), *columns)
