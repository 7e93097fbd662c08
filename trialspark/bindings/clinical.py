"""Clinical queries: events as glucose readings, orders as visits, parts as subjects' profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialspark.bindings.registry import query, rounded, sql_rounded, table
from trialspark.operators import cohorts, glucose


def _readings(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        F.col("user_id").alias("subject"), F.col("ts"), F.col("value").alias("glucose"), F.col("event_type").alias("trial")
    )


def _sql_share(condition: str) -> str:
    return sql_rounded(f"100.0 * avg(CASE WHEN value IS NULL THEN NULL WHEN {condition} THEN 1.0 ELSE 0.0 END)", 6)


def _sql_readings(*columns: str, by: str = "user_id AS subject", keys: str = "user_id") -> str:
    return f"SELECT {by}, count(value) AS n_readings, {', '.join(columns)} FROM events GROUP BY {keys}"


_SQL_BELOW = (f"{_sql_share('value < 70')} AS pct_below_70", f"{_sql_share('value < 54')} AS pct_below_54")
_SQL_ABOVE = (f"{_sql_share('value > 180')} AS pct_above_180", f"{_sql_share('value > 250')} AS pct_above_250")
_SQL_IN = (f"{_sql_share('value BETWEEN 70 AND 180')} AS pct_in_range",)
_SQL_SPREAD = (
    f"{sql_rounded('stddev_samp(value)', 6)} AS sd",
    f"{sql_rounded('100.0 * stddev_samp(value) / nullif(avg(value), 0)', 6)} AS cv",
)
_SQL_MEAN = (
    f"{sql_rounded('avg(value)', 6)} AS mean_glucose",
    f"{sql_rounded('3.31 + 0.02392 * avg(value)', 6)} AS gmi",
)


@query(_sql_readings(*_SQL_BELOW))
def time_below(spark: SparkSession, folder: str) -> DataFrame:
    metrics = glucose.glucose_metrics(_readings(spark, folder), ["subject"], "glucose", glucose.below_range("glucose"))
    return rounded(metrics, 6, "pct_below_70", "pct_below_54")


@query(_sql_readings(*_SQL_ABOVE))
def time_above(spark: SparkSession, folder: str) -> DataFrame:
    metrics = glucose.glucose_metrics(_readings(spark, folder), ["subject"], "glucose", glucose.above_range("glucose"))
    return rounded(metrics, 6, "pct_above_180", "pct_above_250")


@query(_sql_readings(*_SQL_IN))
def time_in_range(spark: SparkSession, folder: str) -> DataFrame:
    metrics = glucose.glucose_metrics(_readings(spark, folder), ["subject"], "glucose", glucose.in_range("glucose"))
    return rounded(metrics, 6, "pct_in_range")


@query(_sql_readings(*_SQL_SPREAD))
def variability(spark: SparkSession, folder: str) -> DataFrame:
    metrics = glucose.glucose_metrics(_readings(spark, folder), ["subject"], "glucose", glucose.variability("glucose"))
    return rounded(metrics, 6, "sd", "cv")


@query(_sql_readings(*_SQL_MEAN))
def gmi(spark: SparkSession, folder: str) -> DataFrame:
    metrics = glucose.glucose_metrics(_readings(spark, folder), ["subject"], "glucose", glucose.mean_and_gmi("glucose"))
    return rounded(metrics, 6, "mean_glucose", "gmi")


@query(
    _sql_readings(
        *_SQL_BELOW, *_SQL_IN, *_SQL_ABOVE, *_SQL_MEAN, *_SQL_SPREAD,
        by="event_type AS trial, user_id AS subject", keys="event_type, user_id",
    )
)
def glucose_summary(spark: SparkSession, folder: str) -> DataFrame:
    """All metrics of every subject in every trial, in one pass."""
    metrics = glucose.glucose_metrics(_readings(spark, folder), ["trial", "subject"], "glucose")
    return rounded(metrics, 6, *metrics.columns[3:])


@query(
    f"""SELECT event_type AS trial, count(CASE WHEN event_type <> 'error' THEN value END) AS n_tests,
    {sql_rounded("avg(CASE WHEN event_type <> 'error' THEN value END)", 6)} AS average
    FROM events GROUP BY event_type"""
)
def a1c_summary(spark: SparkSession, folder: str) -> DataFrame:
    measured = _readings(spark, folder).withColumn(
        "glucose", F.when(F.col("trial") != "error", F.col("glucose"))
    )
    return rounded(cohorts.value_summary(measured, ["trial"], "glucose"), 6, "average")


@query(
    """SELECT c_nationkey, count(CASE WHEN event_type = 'error' THEN 1 END) AS dka,
    count(CASE WHEN event_type IN ('signup', 'view') THEN 1 END) AS severe_hypo
    FROM customer LEFT JOIN events ON user_id = c_custkey GROUP BY c_nationkey"""
)
def adverse_counts(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").withColumnRenamed("user_id", "c_custkey")
    return cohorts.adverse_event_counts(
        events,
        table(spark, folder, "customer"),
        "c_custkey",
        "c_nationkey",
        "event_type",
        {"dka": ["error"], "severe_hypo": ["signup", "view"]},
    )


@query(
    f"""SELECT CASE WHEN p_size < 18 THEN 'pediatric' WHEN p_size >= 18 THEN 'adult' END AS age_cohort,
    p_type AS sex, CASE WHEN p_retailprice < 950 THEN 'normal' WHEN p_retailprice < 1000 THEN 'raised'
    ELSE 'high' END AS bmi_band, count(*) AS n, {sql_rounded('avg(p_retailprice)', 4)} AS average,
    min(p_retailprice) AS least, max(p_retailprice) AS greatest FROM part GROUP BY ALL""",
    name="cohorts",
)
def demographic_cohorts(spark: SparkSession, folder: str) -> DataFrame:
    groups = {
        "age_cohort": cohorts.age_cohort("p_size"),
        "sex": F.col("p_type"),
        "bmi_band": cohorts.bucket("p_retailprice", [950, 1000], ["normal", "raised", "high"]),
    }
    return rounded(cohorts.cohort_summary(table(spark, folder, "part"), groups, "p_retailprice"), 4, "average")


@query(
    f"""SELECT c_mktsegment, count(c_custkey) AS n_subjects, {sql_rounded('avg(c_acctbal)', 4)} AS avg_c_acctbal,
    {sql_rounded('avg(c_nationkey)', 4)} AS avg_c_nationkey FROM customer
    WHERE c_mktsegment IS NOT NULL GROUP BY c_mktsegment"""
)
def arm_breakdown(spark: SparkSession, folder: str) -> DataFrame:
    arms = cohorts.arm_breakdown(
        table(spark, folder, "customer"), "c_mktsegment", "c_custkey", ["c_acctbal", "c_nationkey"]
    )
    return rounded(arms, 4, "avg_c_acctbal", "avg_c_nationkey")


@query(
    f"""WITH ranked AS (
        SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS first_rank,
            row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS last_rank
        FROM orders)
    SELECT o_custkey, count(*) AS n_visits, min(o_orderdate) AS baseline_visit, max(o_orderdate) AS end_visit,
        max(CASE WHEN first_rank = 1 THEN o_totalprice END) AS baseline,
        max(CASE WHEN last_rank = 1 THEN o_totalprice END) AS "end",
        {sql_rounded('max(CASE WHEN last_rank = 1 THEN o_totalprice END) - max(CASE WHEN first_rank = 1 THEN o_totalprice END)', 2)}
            AS change
    FROM ranked GROUP BY o_custkey"""
)
def baseline_change(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    change = cohorts.baseline_change(orders, "o_custkey", "o_orderdate", "o_totalprice", "o_orderkey")
    return rounded(change, 2, "change")


@query(
    """SELECT c_custkey AS pt_id, c_mktsegment, c_nationkey, o_orderkey, o_totalprice
    FROM customer JOIN orders ON c_custkey = o_custkey"""
)
def demo_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    demographics = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("pt_id"), "c_mktsegment", "c_nationkey"
    )
    outcomes = table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return cohorts.link_outcomes(demographics, "pt_id", outcomes, "o_custkey")


_SQL_TERMS = {
    "lows": "value < 70",
    "severe lows": "value < 54",
    "highs": "value > 180",
    "severe highs": "value > 250",
    "in-range": "value BETWEEN 70 AND 180",
    "kids": "k < 18",
    "adults": "k >= 18",
}


@query(
    " UNION ALL ".join(
        f"SELECT '{term}' AS term, count(*) FILTER ({condition}) AS n, count({condition}) AS n_known "
        "FROM (SELECT value, json_extract(props, '$.k')::INTEGER AS k FROM events)"
        for term, condition in _SQL_TERMS.items()
    )
)
def term_cohorts(spark: SparkSession, folder: str) -> DataFrame:
    readings = table(spark, folder, "events").select(
        "value", F.get_json_object("props", "$.k").cast("int").alias("age")
    )
    return cohorts.term_counts(readings, list(_SQL_TERMS), {"glucose": "value", "age": "age"})
