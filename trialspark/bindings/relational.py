"""Relational queries: customers as subjects, market segments as treatment arms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialspark.bindings.registry import query, rounded, sql_rounded, table
from trialspark.operators import relational as ops


@query("SELECT * FROM orders")
def scan_table(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders")


@query('SELECT o_custkey AS "Pt ID", o_orderkey AS visit, o_totalprice AS amount FROM orders')
def project_alias(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        F.col("o_custkey").alias("Pt ID"), F.col("o_orderkey").alias("visit"), F.col("o_totalprice").alias("amount")
    )


@query(
    """SELECT o_orderkey, o_orderdate, o_totalprice FROM orders
    ORDER BY o_totalprice DESC, o_orderkey LIMIT 5"""
)
def first_n(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    return ops.first_rows(orders, 5, "-o_totalprice", "o_orderkey")


@query("SELECT * FROM orders WHERE o_orderstatus = 'F'")
def filter_eq(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").where(F.col("o_orderstatus") == "F")


@query("SELECT * FROM orders WHERE o_orderpriority = 'none'")
def filter_eq_empty(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").where(F.col("o_orderpriority") == "none")


def _rated(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with their rating where one was given."""
    documents = table(spark, folder, "documents").select("doc_id", "lang", "n_chars")
    return documents.join(table(spark, folder, "labels"), "doc_id", "left")


SQL_RATED = "(SELECT doc_id, lang, n_chars, quality, toxic FROM documents LEFT JOIN labels USING (doc_id))"


@query(f"SELECT * FROM {SQL_RATED} WHERE quality IS NOT NULL")
def not_null(spark: SparkSession, folder: str) -> DataFrame:
    return _rated(spark, folder).where(F.col("quality").isNotNull())


@query(
    """SELECT l_orderkey, l_linenumber, l_quantity, l_shipdate FROM lineitem
    WHERE l_quantity BETWEEN 10 AND 20 AND l_shipdate < TIMESTAMP '1997-01-01'"""
)
def between_filter(spark: SparkSession, folder: str) -> DataFrame:
    return (
        table(spark, folder, "lineitem")
        .where(F.col("l_quantity").between(10, 20) & (F.col("l_shipdate") < F.lit("1997-01-01").cast("timestamp_ntz")))
        .select("l_orderkey", "l_linenumber", "l_quantity", "l_shipdate")
    )


@query(
    f"""SELECT count(*) AS n, sum(l_quantity) AS total_quantity,
    {sql_rounded('sum(l_extendedprice)', 2)} AS total_price FROM lineitem"""
)
def global_agg(spark: SparkSession, folder: str) -> DataFrame:
    totals = table(spark, folder, "lineitem").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("l_quantity").alias("total_quantity"),
        F.sum("l_extendedprice").alias("total_price"),
    )
    return rounded(totals, 2, "total_price")


@query(
    f"""SELECT c_mktsegment, count(*) AS n, {sql_rounded('avg(c_acctbal)', 1)} AS average,
    sum(c_nationkey)::BIGINT AS total FROM customer GROUP BY c_mktsegment"""
)
def treatment_breakdown(spark: SparkSession, folder: str) -> DataFrame:
    return ops.breakdown(table(spark, folder, "customer"), "c_mktsegment", "c_acctbal", "c_nationkey")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type ORDER BY n DESC, event_type")
def event_frequency(spark: SparkSession, folder: str) -> DataFrame:
    return ops.frequency(table(spark, folder, "events"), "event_type")


@query(
    f"SELECT quality, count(*) AS n FROM {SQL_RATED} WHERE quality IS NOT NULL GROUP BY quality ORDER BY n DESC"
)
def nonnull_frequency(spark: SparkSession, folder: str) -> DataFrame:
    return ops.frequency(_rated(spark, folder), "quality", skip_nulls=True)


@query(
    f"""SELECT c_mktsegment, c_nationkey, {sql_rounded('avg(o_totalprice)', 2)} AS average,
    count(o_totalprice) AS n FROM customer JOIN orders ON c_custkey = o_custkey
    WHERE o_totalprice IS NOT NULL GROUP BY c_mktsegment, c_nationkey
    ORDER BY c_mktsegment, average DESC"""
)
def join_breakdown(spark: SparkSession, folder: str) -> DataFrame:
    subjects = table(spark, folder, "customer")
    results = table(spark, folder, "orders").withColumnRenamed("o_custkey", "c_custkey")
    by = ["c_mktsegment", "c_nationkey"]
    groups = ops.joined_breakdown(subjects, results, "c_custkey", by, "o_totalprice")
    return ops.sort_rows(groups, "c_mktsegment", "-average", "c_nationkey")


@query(f"SELECT * FROM {SQL_RATED} ORDER BY quality, n_chars DESC NULLS LAST, doc_id")
def sort_nulls_last(spark: SparkSession, folder: str) -> DataFrame:
    return ops.sort_rows(_rated(spark, folder), "quality", "-n_chars", "doc_id")


# Trials with schemas of their own, and one that enrolled nobody.
TRIAL_COLUMNS = {
    "customer": {"subject": "c_custkey", "value": "c_acctbal"},
    "supplier": {"subject": "s_suppkey", "value": "s_acctbal"},
    "orders": {"subject": "o_custkey", "value": "o_totalprice"},
    "events": {"subject": "user_id", "value": "value"},
    "empty": {"subject": "p_partkey", "value": "p_retailprice"},
}


def _trials(spark: SparkSession, folder: str) -> DataFrame:
    tables = {name: table(spark, folder, name) for name in TRIAL_COLUMNS if name != "empty"}
    tables["empty"] = table(spark, folder, "part").where(F.col("p_retailprice") < 0)
    return ops.aligned(tables, TRIAL_COLUMNS)


SQL_TRIALS = "(" + " UNION ALL ".join(
    f"SELECT '{name}' AS trial, {own['subject']} AS subject, {own['value']} AS value FROM "
    + (name if name != "empty" else "part WHERE p_retailprice < 0")
    for name, own in TRIAL_COLUMNS.items()
) + ")"


@query(f"SELECT count(value) AS n, {sql_rounded('avg(value)', 4)} AS average FROM {SQL_TRIALS}")
def combined_trials(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(ops.combined_trials(_trials(spark, folder), "value"), 4, "average")


@query(
    " UNION ALL ".join(
        f"SELECT '{name}' AS trial, count(value) AS n, {sql_rounded('avg(value)', 4)} AS average "
        f"FROM {SQL_TRIALS} WHERE trial = '{name}'"
        for name in TRIAL_COLUMNS
    )
)
def individual_trials(spark: SparkSession, folder: str) -> DataFrame:
    per_trial = ops.individual_trials(_trials(spark, folder), list(TRIAL_COLUMNS), "value")
    return rounded(per_trial, 4, "average")


_SQL_TEXT_NUMBER = "CASE event_type WHEN 'error' THEN 'n/a' ELSE json_extract_string(props, '$.k') END"


@query(
    f"""SELECT user_id, count(try_cast({_SQL_TEXT_NUMBER} AS FLOAT)) AS n_numbers, count(*) AS n,
    {sql_rounded(f'avg(try_cast({_SQL_TEXT_NUMBER} AS FLOAT))', 4)} AS average FROM events GROUP BY user_id"""
)
def numeric_text_avg(spark: SparkSession, folder: str) -> DataFrame:
    text = F.when(F.col("event_type") == "error", "n/a").otherwise(F.get_json_object("props", "$.k"))
    readings = table(spark, folder, "events").select("user_id", text.alias("text"))
    return rounded(ops.text_average(readings, "user_id", "text"), 4, "average")


@query(
    """WITH left_rows AS (SELECT * FROM orders), right_rows AS (
        SELECT o_orderkey, o_custkey, o_orderstatus,
            CASE WHEN o_orderstatus = 'P' THEN -1 ELSE o_totalprice END AS o_totalprice, o_orderdate, o_orderpriority
        FROM orders)
    SELECT 'reordered' AS pair, true AS equal, 0 AS n_only_left, 0 AS n_only_right
    UNION ALL SELECT 'altered', NOT EXISTS (SELECT * FROM left_rows EXCEPT ALL SELECT * FROM right_rows),
        (SELECT count(*) FROM (SELECT * FROM left_rows EXCEPT ALL SELECT * FROM right_rows)),
        (SELECT count(*) FROM (SELECT * FROM right_rows EXCEPT ALL SELECT * FROM left_rows))"""
)
def results_equal(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    reordered = orders.orderBy(F.col("o_totalprice").desc())
    price = F.when(F.col("o_orderstatus") == "P", -1.0).otherwise(F.col("o_totalprice"))
    altered = orders.withColumn("o_totalprice", price)
    return (
        ops.compare_results(orders, reordered)
        .withColumn("pair", F.lit("reordered"))
        .unionByName(ops.compare_results(orders, altered).withColumn("pair", F.lit("altered")))
    )
