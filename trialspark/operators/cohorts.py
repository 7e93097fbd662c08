"""Cohorts, adverse events, visits and subject links."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialspark.operators.glucose import HIGH, LOW, VERY_HIGH, VERY_LOW

ADULT_AGE = 18

# Informal terms -> (measure, lowest value, highest value, are the
# bounds included). None leaves a side open.
TERMS: dict[str, tuple[str, float | None, float | None, bool]] = {
    "lows": ("glucose", None, LOW, False),
    "hypoglycemia": ("glucose", None, LOW, False),
    "severe lows": ("glucose", None, VERY_LOW, False),
    "highs": ("glucose", HIGH, None, False),
    "hyperglycemia": ("glucose", HIGH, None, False),
    "severe highs": ("glucose", VERY_HIGH, None, False),
    "in-range": ("glucose", LOW, HIGH, True),
    "tir": ("glucose", LOW, HIGH, True),
    "kids": ("age", None, ADULT_AGE, False),
    "pediatric": ("age", None, ADULT_AGE, False),
    "adults": ("age", ADULT_AGE, None, True),
}


def term_predicate(term: str, columns: Mapping[str, str]) -> Column:
    """Condition behind an informal term; ``columns`` maps measures to column names."""
    measure, low, high, inclusive = TERMS[term.strip().lower()]
    value = F.col(columns[measure])
    condition = F.lit(True)
    if low is not None:
        condition = condition & (value >= low if inclusive else value > low)
    if high is not None:
        condition = condition & (value <= high if inclusive else value < high)
    return condition


def term_counts(df: DataFrame, terms: Sequence[str], columns: Mapping[str, str]) -> DataFrame:
    """``(term, n, n_known)``: rows meeting each term, and rows where it can be told.

    All terms are counted in one pass over the table and then turned into rows;
    the term list is never joined to it.
    """
    cells: list[Column] = []
    for term in terms:
        condition = term_predicate(term, columns)
        cells.append(
            F.struct(
                F.lit(term).alias("term"),
                F.count_if(condition).alias("n"),
                F.count(condition).alias("n_known"),
            )
        )
    return df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def age_cohort(age: str) -> Column:
    """``pediatric`` below 18, ``adult`` from 18, null if unknown."""
    value = F.col(age)
    return F.when(value < ADULT_AGE, "pediatric").when(value >= ADULT_AGE, "adult")


def bucket(value: str, bounds: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the interval a value falls in: ``labels[i]`` below ``bounds[i]``."""
    if len(labels) != len(bounds) + 1:
        raise ValueError("one more label than bounds is needed")
    column = F.col(value)
    result = F.when(column.isNull(), F.lit(None).cast("string"))
    for bound, label in zip(bounds, labels):
        result = result.when(column < bound, label)
    return result.otherwise(labels[-1])


def cohort_summary(df: DataFrame, cohorts: Mapping[str, Column], value: str) -> DataFrame:
    """Subjects and mean, least and greatest value per combination of cohorts."""
    return df.groupBy(*(column.alias(name) for name, column in cohorts.items())).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(value).alias("average"),
        F.min(value).alias("least"),
        F.max(value).alias("greatest"),
    )


def arm_breakdown(df: DataFrame, arm: str, subject_id: str, values: Sequence[str]) -> DataFrame:
    """Per treatment arm (null arms left out): subjects and the mean of each value."""
    return (
        df.where(F.col(arm).isNotNull())
        .groupBy(arm)
        .agg(
            F.count(subject_id).alias("n_subjects"),
            *(F.avg(value).alias(f"avg_{value}") for value in values),
        )
    )


def value_summary(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Tests done and their mean per group, e.g. for HbA1c; missing values do not count."""
    return df.groupBy(*by).agg(F.count(value).alias("n_tests"), F.avg(value).alias("average"))


def adverse_event_counts(
    events: DataFrame,
    subjects: DataFrame,
    subject_id: str,
    group: str,
    event: str,
    kinds: Mapping[str, Sequence[str]],
) -> DataFrame:
    """Events of each kind per subject group; a group without events shows zeros.

    ``kinds`` maps a result column to the event names it counts. Events are
    counted per subject first, so the join sees one row per subject.
    """
    wanted = [name for names in kinds.values() for name in names]
    counts = [
        F.count_if(F.col(event).isin(*names)).alias(column) for column, names in kinds.items()
    ]
    per_subject = events.where(F.col(event).isin(*wanted)).groupBy(subject_id).agg(*counts)
    return (
        subjects.select(subject_id, group)
        .join(per_subject, subject_id, "left")
        .groupBy(group)
        .agg(*(F.coalesce(F.sum(column), F.lit(0)).alias(column) for column in kinds))
    )


def baseline_change(
    visits: DataFrame,
    subject_id: str,
    visit: str,
    value: str,
    tie_break: str | None = None,
    baseline: Column | None = None,
) -> DataFrame:
    """Per subject: value at baseline, value at the last visit, and the change.

    Baseline is the earliest visit that meets ``baseline`` (visit 0, or a flag;
    default: any visit). ``tie_break`` decides between rows of one visit where
    visits repeat.

    Both ends come from partial aggregates, so no subject's visits are ever
    gathered in one place. Without a tie break they are hash aggregates; with
    one, each task sorts its own rows first.
    """
    at = F.col(visit)
    rank = at if tie_break is None else F.struct(at, F.col(tie_break))
    first_rank = rank if baseline is None else F.when(baseline, rank)
    first_visit = at if baseline is None else F.when(baseline, at)
    return (
        visits.where(at.isNotNull())
        .groupBy(subject_id)
        .agg(
            F.count(F.lit(1)).alias("n_visits"),
            F.min(first_visit).alias("baseline_visit"),
            F.max(at).alias("end_visit"),
            F.min_by(value, first_rank).alias("baseline"),
            F.max_by(value, rank).alias("end"),
        )
        .withColumn("change", F.col("end") - F.col("baseline"))
    )


def link_outcomes(
    demographics: DataFrame, demographics_id: str, outcomes: DataFrame, outcomes_id: str
) -> DataFrame:
    """Outcome rows with their subject's demographics, under the demographics id.

    Adaptive execution broadcasts the demographics when they are measured to be
    small, and splits the partition of a subject that holds too many outcomes.
    """
    return demographics.join(
        outcomes.withColumnRenamed(outcomes_id, demographics_id), demographics_id
    )
