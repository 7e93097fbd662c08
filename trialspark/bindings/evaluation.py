"""Queries that measure: execution accuracy of statement pairs, and sketches against exact figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialspark.bindings.registry import TABLES, query, table
from trialspark.operators.sketches import (
    DISTINCT_ERROR,
    RANK_ERROR,
    daily_sketches,
    merged_sketches,
    rank_errors,
    sketch_summary,
)
from trialspark.plans.accuracy import execution_accuracy as judge_pairs
from trialspark.session import new_workspace

# Predicted and gold statements that read the same in both dialects.
_PAIRS = {
    # Another order, other column names.
    1: (
        "SELECT c_mktsegment, count(*) FROM customer GROUP BY c_mktsegment ORDER BY 2",
        "SELECT c_mktsegment AS arm, count(c_custkey) AS n FROM customer GROUP BY c_mktsegment",
    ),
    # Whole tables, row by row.
    2: ("SELECT * FROM lineitem WHERE l_quantity >= 0", "SELECT * FROM lineitem"),
    # Rows that repeat equally often, and not.
    3: (
        "SELECT o_orderstatus FROM orders UNION ALL SELECT o_orderstatus FROM orders",
        "SELECT o_orderstatus FROM orders WHERE o_custkey % 2 = 0 UNION ALL SELECT o_orderstatus FROM orders"
        " UNION ALL SELECT o_orderstatus FROM orders WHERE o_custkey % 2 <> 0",
    ),
    4: ("SELECT DISTINCT o_orderpriority FROM orders", "SELECT o_orderpriority FROM orders"),
    # The same number of rows, one value changed.
    5: (
        "SELECT event_id, CASE WHEN event_id = 17 THEN value + 1 ELSE value END FROM events",
        "SELECT event_id, value FROM events",
    ),
    # A value swapped between two rows keeps every column's values.
    6: (
        "SELECT c_custkey, CASE c_custkey WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE c_custkey END FROM customer",
        "SELECT c_custkey, c_custkey FROM customer",
    ),
    # Numbers compare by value.
    7: ("SELECT count(*) FROM documents", "SELECT CAST(count(*) AS DOUBLE) FROM documents"),
    # Nulls are values like others.
    8: (
        "SELECT nullif(p_size, 1) FROM part",
        "SELECT CASE WHEN p_size <> 1 THEN p_size END FROM part",
    ),
    9: ("SELECT coalesce(nullif(p_size, 1), 0) FROM part", "SELECT nullif(p_size, 1) FROM part"),
    # A join against a filter by membership.
    10: (
        "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)",
        "SELECT DISTINCT c_custkey FROM customer JOIN orders ON o_custkey = c_custkey",
    ),
    # No rows on either side, and on one.
    11: ("SELECT s_name FROM supplier WHERE s_suppkey < 0", "SELECT s_name FROM supplier WHERE s_name = ''"),
    12: ("SELECT s_name FROM supplier WHERE s_suppkey < 0", "SELECT s_name FROM supplier"),
}
# Statements that give no result to compare, or none of the gold one's form.
_UNCOMPARED = {
    21: ("SELECT no_such_column FROM nation", "SELECT n_name FROM nation", "predicted_failed"),
    22: ("SELECT n_name FROM nation", "SELECT n_name FROM no_such_table", "gold_failed"),
    23: ("DROP TABLE nation", "SELECT n_name FROM nation", "predicted_failed"),
    24: ("SELECT n_name, n_nationkey FROM nation", "SELECT n_name FROM nation", "different"),
    25: ("SELECT n_nationkey FROM nation", "SELECT n_name FROM nation", "different"),
    # Fails only as it runs.
    26: (
        "SELECT CAST(c_name AS BIGINT) FROM customer",
        "SELECT c_custkey FROM customer",
        "predicted_failed",
    ),
}


def _sql_verdict(pair: int, predicted: str, gold: str) -> str:
    return f"""SELECT {pair}::BIGINT AS pair_id,
        CASE WHEN (SELECT count(*) FROM ((FROM ({predicted})) EXCEPT ALL (FROM ({gold})))) = 0
            AND (SELECT count(*) FROM ((FROM ({gold})) EXCEPT ALL (FROM ({predicted})))) = 0
            THEN 'equal' ELSE 'different' END AS verdict,
        (SELECT count(*) FROM ({predicted})) AS n_predicted, (SELECT count(*) FROM ({gold})) AS n_gold"""


@query(
    " UNION ALL ".join(
        [
            *(_sql_verdict(pair, *texts) for pair, texts in _PAIRS.items()),
            *(f"SELECT {pair}, '{row[2]}', NULL, NULL" for pair, row in _UNCOMPARED.items()),
        ]
    )
)
def execution_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    """Verdicts on pairs of statements over all of the tables they name."""
    own = spark.newSession()
    for name in TABLES:
        table(own, folder, name).createOrReplaceTempView(name)
    rows = [(pair, row[0], row[1]) for pair, row in {**_PAIRS, **_UNCOMPARED}.items()]
    verdicts = judge_pairs(own, own.createDataFrame(rows, "pair_id long, predicted string, gold string"))
    return spark.createDataFrame(verdicts.collect(), verdicts.schema)


_QUANTILES = {"median": 0.5, "p95": 0.95}
_ENDS = {"least": 0.0, "greatest": 1.0}


@query(
    """SELECT event_type, date_trunc('week', ts)::DATE AS week, count(*) AS n_readings,
        min(value) AS least, max(value) AS greatest,
        TRUE AS median_within, TRUE AS p95_within, TRUE AS subjects_within
    FROM events WHERE ts IS NOT NULL AND value IS NOT NULL AND NOT isnan(value)
    GROUP BY ALL"""
)
def sketched_weeks(spark: SparkSession, folder: str) -> DataFrame:
    """Weekly figures from stored daily sketches; are they within the stated errors of the exact ones?"""
    events = table(spark, folder, "events").where("ts IS NOT NULL")
    stored = f"{new_workspace(spark, 'sketches')}/daily"
    daily_sketches(events, ["event_type"], "ts", "value", "user_id").write.parquet(stored)
    week = F.to_date(F.date_trunc("week", "day")).alias("week")
    merged = merged_sketches(spark.read.parquet(stored), "event_type", week)
    summary = sketch_summary(merged, _QUANTILES | _ENDS)

    dated = events.withColumn("week", F.to_date(F.date_trunc("week", "ts")))
    keys = ["event_type", "week"]
    off = rank_errors(dated, keys, "value", summary, _QUANTILES)
    exact = dated.where("value IS NOT NULL AND NOT isnan(value)").groupBy(*keys).agg(
        F.count_distinct("user_id").alias("n_exact")
    )
    measured = off.withColumnsRenamed({name: f"off_{name}" for name in _QUANTILES}).join(
        exact.withColumnsRenamed({"event_type": "type", "week": "of"}),
        F.col("event_type").eqNullSafe(F.col("type")) & (F.col("week") == F.col("of")),
    )
    judged = measured.select(
        F.col("event_type").alias("type"),
        F.col("week").alias("of"),
        *((F.col(f"off_{name}") <= RANK_ERROR).alias(f"{name}_within") for name in _QUANTILES),
        "n_exact",
    )
    same = F.col("event_type").eqNullSafe(F.col("type")) & (F.col("week") == F.col("of"))
    return summary.join(judged, same).select(
        *keys,
        "n_readings",
        *_ENDS,
        *(f"{name}_within" for name in _QUANTILES),
        (F.abs(F.col("n_subjects") - F.col("n_exact")) <= DISTINCT_ERROR * F.col("n_exact")).alias("subjects_within"),
    )
