"""Filters, breakdowns and multi-trial combinations over clinical tables.

Aggregates are combinable (count, sum, avg), so a group that holds most rows is
reduced on every executor before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialspark.functions.numeric import number_from_text, round_scaled


def sort_rows(df: DataFrame, *keys: str) -> DataFrame:
    """Multi-key sort with nulls last in both directions; ``-key`` sorts descending."""
    return df.orderBy(
        *(
            F.col(key[1:]).desc_nulls_last() if key.startswith("-") else F.col(key).asc_nulls_last()
            for key in keys
        )
    )


def first_rows(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """First ``n`` rows in key order: a top-k per task and one small merge."""
    return sort_rows(df, *keys).limit(n)


def breakdown(df: DataFrame, by: str, average: str, total: str, digits: int = 1) -> DataFrame:
    """Per group: rows ``n``, rounded mean of one column, sum of another."""
    return df.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"),
        round_scaled(F.avg(average), digits).alias("average"),
        F.sum(total).alias("total"),
    )


def frequency(df: DataFrame, by: str, skip_nulls: bool = False) -> DataFrame:
    """Occurrences of each value, most frequent first."""
    rows = df.where(F.col(by).isNotNull()) if skip_nulls else df
    return sort_rows(rows.groupBy(by).agg(F.count(F.lit(1)).alias("n")), "-n", by)


def joined_breakdown(
    subjects: DataFrame,
    results: DataFrame,
    subject_id: str,
    by: Sequence[str],
    value: str,
    digits: int = 2,
) -> DataFrame:
    """Per subject group: rounded mean and count of the non-null results.

    Results are folded to one ``(sum, count)`` row per subject before the join.
    The join then moves subjects instead of results, a subject with a third of
    all results is one row, and the fold's partitioning serves the join.
    """
    per_subject = (
        results.where(F.col(value).isNotNull())
        .groupBy(subject_id)
        .agg(F.sum(value).alias("_sum"), F.count(value).alias("_n"))
    )
    return (
        subjects.select(subject_id, *by)
        .join(per_subject, subject_id)
        .groupBy(*by)
        .agg(
            round_scaled(F.sum("_sum") / F.sum("_n"), digits).alias("average"),
            F.sum("_n").alias("n"),
        )
    )


def aligned(trials: Mapping[str, DataFrame], columns: Mapping[str, Mapping[str, str]]) -> DataFrame:
    """Rows of several trials under common column names, tagged with ``trial``.

    ``columns[trial]`` maps common names to that trial's own columns; only those
    are read.
    """
    parts = [
        df.select(
            F.lit(name).alias("trial"),
            *(F.col(own).alias(common) for common, own in sorted(columns[name].items())),
        )
        for name, df in trials.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def combined_trials(rows: DataFrame, value: str) -> DataFrame:
    """All trials together: the mean over pooled rows, not the mean of trial means."""
    return rows.agg(F.count(value).alias("n"), F.avg(value).alias("average"))


def individual_trials(rows: DataFrame, trial_names: Sequence[str], value: str) -> DataFrame:
    """Each trial by itself in one pass; a trial without rows keeps its row."""
    spark = rows.sparkSession
    names = spark.createDataFrame([(name,) for name in trial_names], "trial string")
    per_trial = rows.groupBy("trial").agg(F.count(value).alias("n"), F.avg(value).alias("average"))
    return names.join(per_trial, "trial", "left").select(
        "trial", F.coalesce("n", F.lit(0)).alias("n"), "average"
    )


def text_average(df: DataFrame, by: str, text: str) -> DataFrame:
    """Mean of the numbers in a text column; text that is no number does not count."""
    number = number_from_text(text)
    return df.groupBy(by).agg(
        F.count(number).alias("n_numbers"),
        F.count(F.lit(1)).alias("n"),
        F.avg(number).alias("average"),
    )


def compare_results(left: DataFrame, right: DataFrame) -> DataFrame:
    """Do two results hold the same rows, in any order, as often?

    One signed count per distinct row, so one shuffle decides; equal rows cancel
    out before it. Returns ``(equal, n_only_left, n_only_right)``.
    """
    columns = [F.col(f"c{i}") for i in range(len(left.columns))]
    names = [f"c{i}" for i in range(len(left.columns))]
    if len(left.columns) != len(right.columns):
        raise ValueError("results have different numbers of columns")
    signed = left.toDF(*names).withColumn("_sign", F.lit(1)).union(
        right.toDF(*names).withColumn("_sign", F.lit(-1))
    )
    surplus = signed.groupBy(*columns).agg(F.sum("_sign").alias("_surplus"))

    def total(amount: Column) -> Column:
        return F.coalesce(F.sum(F.greatest(amount, F.lit(0))), F.lit(0))

    return surplus.agg(
        total(F.col("_surplus")).alias("n_only_left"),
        total(-F.col("_surplus")).alias("n_only_right"),
    ).select(
        ((F.col("n_only_left") == 0) & (F.col("n_only_right") == 0)).alias("equal"),
        "n_only_left",
        "n_only_right",
    )
