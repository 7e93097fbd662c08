"""Sketches of readings per day: stored once, merged over any span of days later.

A quantile sketch and a distinct-count sketch stay a few kilobytes however many readings
they saw, and merge without loss. A group's readings are folded where they lie; only one
row per group, day and task is shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Size of a quantile sketch; the error of a rank shrinks with it.
QUANTILE_SIZE = 1024
# Logarithm of the number of registers of a distinct-count sketch.
DISTINCT_SIZE = 12
# Stated errors for these sizes: share of readings by which a quantile's rank is off (twice
# the 99 % bound 2.296 / size ** 0.9021 of the KLL sketch, rounded up), and share by which
# a distinct count is off (three standard errors of 1.04 / sqrt(2 ** 12), rounded up).
RANK_ERROR = 0.01
DISTINCT_ERROR = 0.05


def daily_sketches(
    readings: DataFrame, by: Sequence[str], time: str, value: str, subject: str
) -> DataFrame:
    """One row per group and day: ``n_readings``, ``value_sketch`` and ``subject_sketch``.

    Rows without a time or a value (null or NaN) do not count. A null subject's readings
    count, the subject does not. A null group is a group.
    """
    number = F.col(value).cast("double")
    present = readings.where(F.col(time).isNotNull() & number.isNotNull() & ~F.isnan(number))
    return present.groupBy(*by, F.to_date(time).alias("day")).agg(
        F.count(F.lit(1)).alias("n_readings"),
        F.kll_sketch_agg_double(number, F.lit(QUANTILE_SIZE)).alias("value_sketch"),
        F.hll_sketch_agg(subject, F.lit(DISTINCT_SIZE)).alias("subject_sketch"),
    )


def merged_sketches(sketches: DataFrame, *by: str | Column) -> DataFrame:
    """Stored sketches merged over coarser groups, in the same columns."""
    return sketches.groupBy(*by).agg(
        F.sum("n_readings").alias("n_readings"),
        F.kll_merge_agg_double("value_sketch", F.lit(QUANTILE_SIZE)).alias("value_sketch"),
        F.hll_union_agg("subject_sketch").alias("subject_sketch"),
    )


def sketch_summary(sketches: DataFrame, quantiles: Mapping[str, float]) -> DataFrame:
    """Sketches replaced by what they estimate: quantiles by name, and ``n_subjects``.

    The quantiles 0 and 1 are the least and the greatest reading, without error.
    """
    kept = [name for name in sketches.columns if name not in ("value_sketch", "subject_sketch")]
    return sketches.select(
        *(F.col(f"`{name}`") for name in kept),
        *(F.kll_sketch_get_quantile_double("value_sketch", F.lit(float(q))).alias(name) for name, q in quantiles.items()),
        F.hll_sketch_estimate("subject_sketch").alias("n_subjects"),
    )


def rank_errors(
    readings: DataFrame, by: Sequence[str], value: str, summary: DataFrame, quantiles: Mapping[str, float]
) -> DataFrame:
    """How far off the estimated quantiles' ranks are, measured on the readings themselves.

    One row per group of ``summary``, with the share of readings between the wanted rank
    and the nearest rank of the estimate, in a column named like the quantile. Groups
    without readings are left out. ``summary`` has one row per group, so the readings fold
    to one row per group before anything is shuffled on the groups.
    """
    number = F.col(value).cast("double")
    present = readings.where(number.isNotNull() & ~F.isnan(number)).select(*by, number.alias("_reading"))
    same = None
    right = summary.select(*(F.col(name).alias(f"_by{i}") for i, name in enumerate(by)), *quantiles)
    for i, name in enumerate(by):
        equal = F.col(name).eqNullSafe(F.col(f"_by{i}"))
        same = equal if same is None else same & equal
    counts = []
    for name in quantiles:
        counts.append((F.count_if(F.col("_reading") < F.col(name)) / F.count(F.lit(1))).alias(f"_below_{name}"))
        counts.append((F.count_if(F.col("_reading") <= F.col(name)) / F.count(F.lit(1))).alias(f"_upto_{name}"))
    ranks = present.join(right, same).groupBy(*by).agg(*counts)
    off = [
        F.greatest(F.lit(0.0), F.col(f"_below_{name}") - q, q - F.col(f"_upto_{name}")).alias(name)
        for name, q in quantiles.items()
    ]
    return ranks.select(*by, *off)
